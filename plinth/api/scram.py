"""SCRAM-SHA-256 (RFC 5802, RFC 7677): the stored form of a password and the server's side of the exchange."""

import base64
import hashlib
import hmac
import secrets

ITERATIONS = 4096


class AuthenticationFailed(PermissionError):
    pass


def _mac(key: bytes, text: bytes) -> bytes:
    return hmac.digest(key, text, "sha256")


def _b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


def verifier(password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> str:
    """SCRAM-SHA-256$iterations:salt$stored key:server key, as pg_shadow shows it."""
    salt = salt or secrets.token_bytes(16)
    salted = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations)
    stored = hashlib.sha256(_mac(salted, b"Client Key")).digest()
    return f"SCRAM-SHA-256${iterations}:{_b64(salt)}${_b64(stored)}:{_b64(_mac(salted, b'Server Key'))}"


class Exchange:
    """One login: first() answers the client's first message, final() checks its proof and gives the server's."""

    def __init__(self, stored: str, nonce: str | None = None):
        _, head, keys = stored.split("$")
        self.iterations, self.salt = head.split(":")
        self.stored, self.server = (base64.b64decode(x) for x in keys.split(":"))
        self.nonce = nonce or secrets.token_urlsafe(18)

    def first(self, message: str) -> str:
        flag, _, self.bare = message.split(",", 2)
        if flag.startswith("p"):
            raise AuthenticationFailed("channel binding is not supported")
        self.header = message[: len(message) - len(self.bare)]
        self.nonce = dict(x.split("=", 1) for x in self.bare.split(","))["r"] + self.nonce
        self.challenge = f"r={self.nonce},s={self.salt},i={self.iterations}"
        return self.challenge

    def final(self, message: str) -> str:
        without, proof = message.rsplit(",p=", 1)
        said = dict(x.split("=", 1) for x in without.split(","))
        signed = f"{self.bare},{self.challenge},{without}".encode()
        given = base64.b64decode(proof)
        expected = _mac(self.stored, signed)
        key = bytes(a ^ b for a, b in zip(given, expected, strict=True)) if len(given) == len(expected) else b""
        if said.get("r") != self.nonce or said.get("c") != _b64(self.header.encode()) or not hmac.compare_digest(hashlib.sha256(key).digest(), self.stored):
            raise AuthenticationFailed("password authentication failed")
        return f"v={_b64(_mac(self.server, signed))}"
