"""Exact substring dedup: a sparse suffix array, sorted deep-shallow.

Every byte covered by a `length`-byte string that also starts elsewhere goes. Sorting all suffixes of a corpus isn't
needed for that. Winnowing gives each string an anchor: the leftmost least k-gram hash among its first `window` positions, so its content
alone decides the anchor's offset, and equal strings have it at the same one. A place (a text's anchor, with the offsets low to high of the strings
that have it) stands for the strings of its context: high bytes before it to length - low behind it. Hence:

1. Places of all texts with two hashes: key, of the length - window + 1 bytes behind the anchor that all its strings
   hold, and ctx, of the context. Places whose key occurs once are dropped.
2. Places of equal contexts are one entry of the suffix array, with several places: all its strings are repeated.
3. Keys with several contexts have a group, to which one place of each context goes. There suffixes at the anchors and reversed prefixes before them are sorted deep-shallow: multikey quicksort on 8-byte
   super-characters to a shallow depth, then blind tries order what still shares a long prefix. Common prefixes of
   neighbours give, for each offset, classes of equal strings; a context in a class with another is repeated there.
4. Repeated intervals return to their rows, are merged, and cut out.

No group has more than `most_contexts` contexts. A larger one is split by its contexts: the offsets fall into PARTS ranges, and all strings with an
offset in a range share the bytes from the range's first offset before the anchor to `length` less its last one behind it.
The hash of these is the place's key for that range, and steps 2 and 3 are taken again; what is then still too large is split into
single offsets, where the places of a key have one string. Places are counted with map-side combining and joined, never gathered.
"""

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.shared import row_name, written

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
CHUNK = 16384
PARTS = 8
SHALLOW = 64


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, and a random word for each byte."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    words = np.random.default_rng(base & 0xFFFF).integers(1, 1 << 64, 256, np.uint64)
    return up, down, words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_of(length: int, k: int) -> int:
    """Positions among which a string's anchor is chosen: more make fewer places, less make keys that tell more apart."""
    return (length - k) * 3 // 4 + 1


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Positions, lowest and highest offsets, keys and context hashes of a text's places, in segments of bounded memory.

    A string belongs to one place. Where a segment ends within an anchor's strings, the anchor has two places. Of places
    with equal contexts that follow each other, some are left out.
    """
    w, found = window_of(length, k), []
    up, down, words = _powers(_BASE, SEGMENT + 8192)
    for begin in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[begin : begin + SEGMENT + length - 1]
        starts = len(part) - length + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(words[part] * up[: len(part)], out=sums[1:])
        m = starts + w - 1
        h = _mixed((sums[k : k + m] - sums[:m]) * down[:m])
        v = (h & np.uint64(0xFFFFFFFFFFF80000)) | np.arange(m, dtype=np.uint64)  # leftmost of equal hashes wins
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max)
        padded[:m] = v
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        p = (np.minimum(behind[:starts], ahead[w - 1 : m]) & np.uint64(0x7FFFF)).astype(np.int64)  # of each start
        first = np.flatnonzero(np.diff(p, prepend=-1))
        last = np.append(first[1:], starts) - 1
        p = p[first]
        low, high = p - last, p - first
        key = _mixed((sums[p + length - w + 1] - sums[p]) * down[p])
        ctx = _mixed((sums[last + length] - sums[first]) * down[first] + (low * 8192 + high).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        # in a row of equal contexts (a short period) those will do whose strings cover all, a first and a last one among them
        other = np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))
        far = (first - np.maximum.accumulate(np.where(other, first, 0))) // (length // 4)
        take = np.flatnonzero(other | np.append(other[1:], True) | np.append(True, far[1:] != far[:-1]))
        found.append((p[take] + begin, low[take], high[take], key[take].view(np.int64), ctx[take].view(np.int64)))
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else [()] * 5))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie(items: list[int], strings: list[bytes]) -> list[int]:
    """items in the order of their strings. Inner nodes hold a depth and branches by byte (-1: the string ends), and
    nothing of the text skipped: a search goes down blindly to a leaf, one comparison with it finds the place."""
    root: list = [items[0]]  # a leaf is a list of items with equal strings, an inner node a tuple (depth, {byte: node})
    for item in items[1:]:
        s = strings[item]
        node = root
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        t = strings[node[0]]
        same = common_prefix(s, t)
        if same == len(s) == len(t):
            node.append(item)
            continue
        over, key, node = None, None, root
        while isinstance(node, tuple) and node[0] < same:
            over, key = node, s[node[0]]
            node = node[1][key]
        mine = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [item]
            continue
        new = (same, {t[same] if same < len(t) else -1: node, mine: [item]})
        if over is None:
            root = new
        else:
            over[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out += node
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(items: list[int], strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """items sorted by their strings: multikey quicksort to depth `shallow`, blind tries below."""
    out, stack = [], [(items, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie(group, strings)
        else:
            word = {i: (s[depth : depth + 8], min(len(s), depth + 8)) for i in group for s in (strings[i],)}
            pivot = word[group[len(group) // 2]]
            equal = [i for i in group if word[i] == pivot]
            ended = pivot[1] < depth + 8
            more = [i for i in group if word[i] > pivot]
            less = [i for i in group if word[i] < pivot]
            if more:
                stack.append((more, depth))
            stack.append((equal, shallow if ended else depth + 8))
            if less:
                stack.append((less, depth))
    return out


def _order(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All items, sorted by group, then string; and the common prefix of each with the one before it (-1: another group)."""
    order: list[int] = []
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(groups)]]).tolist()):
        order += deep_shallow(list(range(a, b)), strings)
    lcp = [-1] * len(order)
    for i in range(1, len(order)):
        a, b = order[i - 1], order[i]
        if groups[a] == groups[b]:
            lcp[i] = common_prefix(strings[a], strings[b])
    return np.array(order), np.array(lcp)


def repeated(groups: np.ndarray, before: list[bytes], after: list[bytes], length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the most and the fewest bytes before the anchor, from low to high, with which a repeated string starts (-1: none).

    groups must be sorted; before holds reversed prefixes.
    """
    n_before, n_after = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    most, fewest = np.full(len(groups), -1), np.full(len(groups), -1)
    work = np.flatnonzero(np.bincount(groups)[groups] > 1)
    if not len(work):
        return most, fewest
    g = groups[work]
    by_after, after_lcp = _order(g, [after[i] for i in work])
    by_before, before_lcp = _order(g, [before[i] for i in work])
    na, nb, low, high = n_after[work], n_before[work], low[work], high[work]
    m = len(work)
    ra, rb = np.empty(m, np.int64), np.empty(m, np.int64)
    lo, hi = np.full(m, -1), np.full(m, -1)
    for d in range(int(low.min()), int(high.max()) + 1):
        ra[by_after] = np.cumsum(after_lcp < length - d)
        rb[by_before] = np.cumsum(before_lcp < d)
        sound = np.flatnonzero((na >= length - d) & (nb >= d) & (low <= d) & (d <= high))
        if len(sound) < 2:
            continue
        pair = ra[sound] * (m + 1) + rb[sound]
        o = np.argsort(pair, kind="stable")
        p = pair[o]
        same = p[1:] == p[:-1]
        twice = np.zeros(len(p), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = sound[o[twice]]
        hi[hit] = d
        fresh = hit[lo[hit] < 0]
        lo[fresh] = d
    found = np.flatnonzero(hi >= 0)
    most[work[found]], fewest[work[found]] = hi[found], lo[found]
    return most, fewest


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: at: pos, high and low offset in one number, of 12 bits each for the offsets.
PLACE = "key long, ctx long, rk binary, at long"
CONTEXT = "key long, lo int, hi int, content binary, rk binary, pos long, many boolean"
SPAN = "rk binary, start long, end long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batches(rows, schema: str, size: int = 4000):
    """Record batches of an iterable of tuples."""
    fields = [c.split() for c in schema.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*held), fields)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _anchor_rows(rows: DataFrame, length: int, k: int) -> DataFrame:
    """PLACE rows of all texts."""

    def run(batches):
        for batch in batches:
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(_bytes(text), np.uint8)
                if len(data) >= length:
                    pos, low, high, key, ctx = anchors(data, length, k)
                    for at in range(0, len(pos), 20_000):
                        cut = slice(at, at + 20_000)
                        yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(ctx[cut]), pa.array([rk] * len(pos[cut]), pa.binary()), pa.array(pos[cut] << 24 | high[cut] << 12 | low[cut])], [c.split()[0] for c in PLACE.split(", ")])

    return rows.select("rk", "text").mapInArrow(run, PLACE)


def _context_rows(texts: DataFrame, length: int) -> DataFrame:
    """CONTEXT rows of the items (pos, key, lo, hi, many) in the list `at` of each text: content from hi bytes before the anchor on."""

    def rows(batches):
        for batch in batches:
            for rk, text, at in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                data = _bytes(text)
                for pos, key, lo, hi, many in sorted({(x["pos"], x["key"], x["lo"], x["hi"], x["many"]) for x in at}):
                    yield key, lo, hi, data[pos - hi : pos + length - lo], rk, pos, many

    return texts.mapInArrow(lambda batches: _batches(rows(batches), CONTEXT), CONTEXT)


def _range_rows(contexts: DataFrame, length: int, window: int, step: int) -> DataFrame:
    """PLACE rows of contexts in ranges of `step` offsets. key: of what all strings with an offset in the range share; ctx: of all that they reach."""

    def rows(batches):
        for batch in batches:
            for key, lo, hi, data, rk, pos in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for a in range(lo // step * step, hi + 1, step):
                    b = min(window, a + step) - 1
                    low, high = max(a, lo), min(b, hi)
                    shared = xxhash.xxh3_64_intdigest(data[hi - a : hi + length - b], (key ^ a * _BASE) % (1 << 64))
                    reached = xxhash.xxh3_64_intdigest(data[hi - high : hi + length - low], low << 32 | high)
                    yield shared - (1 << 63), reached - (1 << 63), rk, pos << 24 | high << 12 | low

    return contexts.mapInArrow(lambda batches: _batches(rows(batches), PLACE), PLACE)


def _narrowed(items: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """CONTEXT rows of items (key, rk, pos, lo, hi, many), cut out of the contexts that they are ranges of."""
    wide = contexts.select("rk", "pos", F.col("lo").alias("least"), F.col("hi").alias("most"), "content")
    inside = items.hint("merge").join(wide, ["rk", "pos"]).filter("lo >= least AND hi <= most")
    content = F.substring("content", F.col("most") - F.col("hi") + 1, F.col("hi") - F.col("lo") + length)
    return inside.select("key", "lo", "hi", content.alias("content"), "rk", "pos", "many")


def _intervals(contexts: DataFrame, length: int) -> DataFrame:
    """SPAN rows of repeated bytes. Rows stream in order of key: memory is CHUNK contexts, or those of one group."""
    dealt = contexts.repartition("key").sortWithinPartitions("key")

    def flush(groups, held):
        if groups:
            before = [c[:hi][::-1] for _, hi, c, _, _ in held]
            after = [c[hi:] for _, hi, c, _, _ in held]
            most, fewest = repeated(np.array(groups), before, after, length, np.array([x[0] for x in held]), np.array([x[1] for x in held]))
            for (_, _, _, rk, pos), m, f in zip(held, most.tolist(), fewest.tolist()):
                if m >= 0:
                    yield rk, pos - m, pos - f + length

    def rows(batches):
        at, groups, held = None, [], []
        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != at and len(groups) >= CHUNK:
                    yield from flush(groups, held)
                    groups, held = [], []
                groups.append(groups[-1] + (key != at) if groups else 0)
                held.append(row)
                at = key
        yield from flush(groups, held)

    return dealt.mapInArrow(lambda batches: _batches(rows(batches), SPAN), SPAN)


def _sorted_out(places: DataFrame, length: int, most_contexts: int) -> tuple[DataFrame, DataFrame]:
    """(SPAN rows, items) of places whose key occurs again: of equal contexts all strings are repeated; items are a place of each context of keys
    with several, with many: whether these are too many for a group."""
    # aggregates are written: both sides of a join are then shuffled for it (neither has a bound), so that Spark can split a hot key
    keys = written(places.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("least"), F.max("ctx").alias("greatest")).filter("n > 1"), "keys")
    again = written(places.hint("merge").join(keys, "key").select(*places.columns, (F.col("least") == F.col("greatest")).alias("one")), "again")
    several = again.filter("NOT one")
    contexts = written(several.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("rk", "at")).alias("x")), "contexts")
    sizes = written(contexts.groupBy("key").agg(F.count("*").alias("m")), "sizes")
    equal = again.filter("one").unionByName(several.hint("merge").join(contexts.filter("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi"))
    pos, hi, lo = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(4095), F.col("at").bitwiseAND(4095)
    spans = equal.select("rk", (pos - hi).alias("start"), (pos - lo + length).alias("end"))
    items = contexts.hint("merge").join(sizes, "key").select("key", "x.*", "m")
    return spans, items.select("key", "rk", pos.alias("pos"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), (F.col("m") > most_contexts).alias("many"))


def dedup(docs: DataFrame, length: int = 400, k: int = 32, most_contexts: int = 5_000, least_words: int = 0, rest: list | None = None) -> DataFrame:
    """(doc_id, rk, n_bytes, spans, kept) of each row of docs (doc_id, text): repeated runs and the bytes that are left.

    Null texts are empty. Texts shorter than `length` stay whole; repeated rows repeat each other. Matches within one
    text count, overlapping ones too. An empty table gives no rows. least_words: runs of fewer words (at white space, parts of words
    count) stay. rk is a 128-bit name of (doc_id, text). rest: columns carried along as a struct `rest`. most_contexts bounds what a
    task holds of one group and changes no result.
    """
    if not k < length < 4096:
        raise ValueError("a string needs more bytes than an anchor, and less than 4096")
    extra = F.struct(*rest) if rest else F.lit(None).cast("struct<none:boolean>")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), extra.alias("rest")).withColumn("rk", row_name(F.col("doc_id"), F.col("text")))
    dealt = rows.select("rk", "doc_id", "text", "rest").repartition("rk")
    # all uses of dealt read all its columns, so that one shuffle serves them
    window = window_of(length, k)
    equal, items = _sorted_out(written(_anchor_rows(rows, length, k), "places"), length, most_contexts)
    lists = items.groupBy("rk").agg(F.collect_list(F.struct("pos", "key", "lo", "hi", "many")).alias("at"))
    contexts = written(_context_rows(dealt.hint("merge").join(lists, "rk").select("rk", "text", "at", "doc_id", "rest"), length), "contents")
    spans, few, many = [equal], [contexts.filter("NOT many")], contexts.filter("many")
    for step in (-(-window // PARTS), 1):
        if many.isEmpty():
            break
        equal, items = _sorted_out(written(_range_rows(many, length, window, step), "ranges"), length, most_contexts)
        parts = written(_narrowed(items, many, length), "parts")
        spans.append(equal)
        few.append(parts.filter("NOT many"))
        many = parts.filter("many")
    spans = reduce(DataFrame.unionByName, spans, _intervals(reduce(DataFrame.unionByName, few), length))
    by_row = spans.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def cut(batches):
        for batch in batches:
            n, runs, kept = [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = _bytes(text)
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                if least_words:
                    merged = [r for r in merged if len(data[r[0] : r[1]].split()) >= least_words]
                ends = [0, *(x for r in merged for x in r), len(data)]
                n.append(len(data))
                runs.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), batch.column(4)], ["rk", "doc_id", "n_bytes", "spans", "kept", "rest"])

    joined = dealt.hint("merge").join(by_row, "rk", "left").select("rk", "doc_id", "text", "runs", "rest")
    out = T.StructType([T.StructField("rk", T.BinaryType()), joined.schema["doc_id"], *T._parse_datatype_string("n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields, joined.schema["rest"]])
    return joined.mapInArrow(cut, out).withColumn("doc_id", F.col("doc_id").cast("long"))


def cut_out(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with repeated passages cut out of `text`; n_chars follows it where it exists.

    Bytes of a character that a cut splits go too; null texts stay null.
    """
    names = docs.columns
    rest = [F.col("text").isNull().alias("c_null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]]
    found = dedup(docs, rest=rest, **options)

    @F.pandas_udf("string")
    def readable(kept):
        return kept.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))

    whole = F.when(F.col("rest.c_null"), F.lit(None)).when(F.size("spans") == 0, F.col("kept").cast("string"))
    found = found.withColumn("clean", whole.otherwise(readable(F.when(F.size("spans") > 0, F.col("kept")))))
    columns = []
    for i, c in enumerate(names):
        value = F.col("clean") if c == "text" else F.col(f"rest.c{i}")
        if c == "n_chars":
            value = F.coalesce(F.char_length("clean").cast(docs.schema[c].dataType), value)
        columns.append(value.alias(c))
    return found.select(*columns)


def query(documents: DataFrame) -> DataFrame:
    out = dedup(documents).drop("rest")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
