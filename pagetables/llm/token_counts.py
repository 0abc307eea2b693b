"""Token counts by section, attributed by offsets.

A document is encoded once, as a whole. The vocabulary's tokens are byte strings, so the
running sum of their lengths gives every token's span in the text. Sections (the fields
of a record or the parts of a text) are spans too, and an interval join of the two sorted
lists says which sections a token touches.

A token that crosses a border goes by an explicit rule:

* ``start``: the section that holds its first byte (the default),
* ``most``: the section that holds most of its bytes, the earlier one of equals,
* ``share``: every section it touches gets the share of its bytes that lie there.

Under each rule the sections' counts add up to the document's count. Null and empty texts
have no sections. Repeated rows are counted each. Input columns named like output columns
are replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, without

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "most", "share")


class ByteTokens:
    """A byte-level vocabulary and the length of each token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset at which each token ends."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.cumsum(self.sizes[ids])


_TOKENS: dict[str, ByteTokens] = {}


def tokens_of(path: str | None = None, pattern: str | None = None) -> ByteTokens:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path, pattern or public_tokenizers.PATTERN)
    return _TOKENS[path]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section; both lists of ends go up to the end of the text. Empty
    sections get nothing."""
    counts = np.zeros(len(section_ends))
    if not len(token_ends):
        return counts
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    inside = first == last
    owner = first[inside] if rule != "start" else first
    counts += np.bincount(owner, minlength=len(counts))
    if rule == "start":
        return counts
    for s, e, a, b in zip(starts[~inside].tolist(), token_ends[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist()):
        cuts = np.clip(np.concatenate([[s], section_ends[a:b], [e]]), s, e)
        part = np.diff(cuts)
        if rule == "most":
            counts[a + int(part.argmax())] += 1
        else:
            counts[a : b + 1] += part / (e - s)
    return counts


def line_ends(raw: bytes) -> np.ndarray:
    """Sections of a text: its lines, each with its line end."""
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(raw) else np.append(cuts, len(raw))


def _sections(parts, rule: str, path: str | None, pattern: str | None):
    """UDF over texts: (section, start, n_chars, n_tokens) for each section of ``parts``."""
    fields = [("section", pa.int32()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.float64())]
    kind = pa.list_(pa.struct(fields))

    def of(texts: pa.Array) -> pa.Array:
        tokens, columns, sizes = tokens_of(path, pattern), [[], [], [], []], [0]
        for raw in raw_texts(texts):
            if not raw:
                sizes.append(0)
                continue
            ends = parts(raw)
            counts = attribute(tokens.ends(raw.decode()), ends, rule)
            # Bytes that begin a character, so that spans are told in characters.
            heads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            chars = heads[np.maximum(ends, 1) - 1] * (ends > 0)
            begins = np.concatenate([[0], chars[:-1]])
            for c, values in zip(columns, (np.arange(len(ends)), begins, chars - begins, counts)):
                c.append(values)
            sizes.append(len(ends))
        flat = [pa.array(np.concatenate(c) if c else [], t) for c, (_, t) in zip(columns, fields)]
        rows = pa.StructArray.from_arrays(flat, fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows).cast(kind)

    spark_type = "array<struct<section: int, start: bigint, n_chars: bigint, n_tokens: double>>"
    return F.arrow_udf(of, spark_type).asNondeterministic()


def count_sections(
    docs: DataFrame, text: str = "text", parts=line_ends, rule: str = "start", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The other columns with one row per section: section, start, n_chars (both in
    characters) and n_tokens. ``parts`` gives the byte offsets at which sections end."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    names = ("section", "start", "n_chars", "n_tokens")
    own = [F.col(f"`{c}`") for c in without(docs, text, "_s", "_r", *names).columns]
    found = docs.select(*own, _sections(parts, rule, path, pattern)(F.col(text).cast("string")).alias("_s"))
    return found.select(*own, F.explode("_s").alias("_r")).select(*own, *[f"_r.{n}" for n in names])


def count_fields(
    docs: DataFrame, fields: list[str], separator: str = "\n", rule: str = "start", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The documents with ``n_tokens_<field>`` for each field and ``n_tokens``, where a
    document is its fields joined by ``separator``; a separator belongs to the field
    before it, null fields are empty."""

    def of(*columns: pa.Array) -> pa.Array:
        tokens, out, mark = tokens_of(path, pattern), [], separator.encode()
        for values in zip(*map(raw_texts, columns)):
            whole = [(v or b"") + mark for v in values[:-1]] + [values[-1] or b""]
            ends = np.cumsum([len(w) for w in whole])
            out.append(attribute(tokens.ends(b"".join(whole).decode()), ends, rule))
        return pa.array(out, pa.list_(pa.float64()))

    names = [f"n_tokens_{f}" for f in fields]
    own = without(docs, "_f", "n_tokens", *names)
    counted = F.arrow_udf(of, "array<double>").asNondeterministic()(*[F.col(f"`{f}`").cast("string") for f in fields])
    found = own.withColumn("_f", counted)
    each = [F.col("_f")[i].alias(n) for i, n in enumerate(names)]
    total = F.aggregate("_f", F.lit(0.0), lambda a, x: a + x).alias("n_tokens")
    return found.select(*[F.col(f"`{c}`") for c in own.columns], *each, total)
