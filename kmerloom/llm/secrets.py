"""Secrets in texts: plain patterns, and strings that a vocabulary finds hard to write.

Three patterns give the base: assignments to names such as ``password``,
access keys, and runs of hex digits.  The token-efficiency test adds runs of
letters, digits and a few marks that have few characters a token under a
tiktoken vocabulary: words of any language are made of long tokens, random
strings of short ones.  Runs that are known digests or identifiers are left
out first: digests by their lengths in hex or their prefix, UUIDs, numbers
with or without separators, and names made of words.

Defined results: null and empty texts have no spans; spans of one kind never
overlap; a run that meets a span of the base is not added; positions are code
points, ends exclusive; repeated rows are scanned alike; other columns do not
matter, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import small_batches

#: Base patterns (fixed): kind, pattern, group whose length counts, least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", re.compile(ASSIGN, re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # a run of 16 or more is the whole of a run, so shorter ones need no match
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
RANDOM = "random"
KINDS = (*(kind for kind, *_ in BASE), RANDOM)
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters a token below which a run counts as random; shortest run; characters that are tokenised at a time.
MIN_RATIO, MIN_RUN, STEP = 2.0, 16, 1024

_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAMED_DIGEST = re.compile(r"(md5|sha-?(1|224|256|384|512))[-_/][A-Za-z0-9+/]+={0,2}", re.ASCII | re.IGNORECASE)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_-]+|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9-]+Z?")
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(name: str = VOCABULARY) -> tiktoken.Encoding:
    """The worker's encoding for a file of ranks, by its public name or its path."""
    if name not in _ENCODINGS:
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _ENCODINGS[name] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def is_known(run: str) -> bool:
    """Whether a run is a digest or an identifier by its form."""
    if _HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    if _NAMED_DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    return _is_name(run)


def _is_name(run: str) -> bool:
    """Whether all parts between marks are words, with numbers of up to four digits behind them; single letters make no words."""
    for part in re.split(r"[+/_-]+", run.rstrip("=")):
        letters = part.rstrip("0123456789")
        if len(part) - len(letters) > 4 or re.search("[0-9]", letters):
            return False
        words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", letters)
        # title case in words of three letters on average; random letters change their case more often
        if words and sum(map(len, words)) < 3 * len(words):
            return False
    return True


def ratio(run: str, coder: tiktoken.Encoding) -> float:
    """Characters a token, tokenised in steps so that a very long run stays cheap."""
    return len(run) / sum(len(coder.encode_ordinary(run[i : i + STEP])) for i in range(0, len(run), STEP))


def spans(text: str | None, coder: tiktoken.Encoding, min_ratio: float = MIN_RATIO) -> list[tuple[str, int, int, float | None]]:
    """Kind, start, end and, for random runs, characters a token; ordered by start and then by kind as in ``KINDS``."""
    if not text:
        return []
    out: list[tuple[str, int, int, float | None]] = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((kind, m.start(), m.end(), None))
    base = sorted((a, b) for _, a, b, _ in out)
    at = reach = 0
    for m in _RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():  # the spans of the base that begin before the run ends
            reach = max(reach, base[at][1])
            at += 1
        if reach > m.start() or is_known(m[0]):
            continue
        r = ratio(m[0], coder)
        if r < min_ratio:
            out.append((RANDOM, m.start(), m.end(), r))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,ratio:double>>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per row: its key, ``spans`` (kind, start, end, characters a token) and ``redacted``, the text with the kinds in their place."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans(t, coder, min_ratio) for t in texts]
            structs = [[dict(zip(("kind", "start", "end", "ratio"), s, strict=True)) for s in x] for x in found]
            changed = [redact(t, x) for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(structs, kinds), pa.array(changed, pa.string())], ["key", "spans", "redacted"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, spans {SPANS}, redacted string").withColumnRenamed("key", key)


def redact(text: str | None, found: list[tuple[str, int, int, float | None]]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first one in angle brackets."""
    if not found:
        return text
    out, at = [], 0
    for kind, start, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def counted(found: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column, base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    if base_only:
        found = F.filter(found, lambda s: s["kind"] != RANDOM)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
