"""Settings of the server, from arguments or the environment."""

import argparse
import os
from dataclasses import dataclass, fields


@dataclass
class ServerConfig:
    """Each field is an option (--warehouse) and an environment variable (PLINTH_WAREHOUSE); options win.

    With a password set, clients must prove that they know it (SCRAM-SHA-256); without one, the user's name is enough.
    """

    host: str = "127.0.0.1"
    port: int = 54321
    database: str = "plinth"
    user: str = "plinth"
    password: str = ""
    warehouse: str = ""
    catalog: str = ":memory:"
    log_level: str = "ERROR"

    @classmethod
    def read(cls, args: list[str] | None = None) -> "ServerConfig":
        parser = argparse.ArgumentParser(prog="plinth.api.wire")
        for f in fields(cls):
            parser.add_argument("--" + f.name.replace("_", "-"), type=f.type, default=f.type(os.environ.get(f"PLINTH_{f.name.upper()}", f.default)))
        return cls(**vars(parser.parse_args(args)))
