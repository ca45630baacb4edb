"""Secret scans: base patterns, and a token-efficiency test for random strings.

Ordinary words take few tokens of a byte-pair vocabulary; random strings take one for every two or three characters.
Strings of letters, digits and a few signs that have letters, are long enough, and have few characters per token are
reported, unless they are digests of a known length, UUIDs, numbers, or identifiers made of words. Every step is linear
in the text: patterns can't backtrack, identifiers are cut into pieces once, and tokens are counted window by window.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import arrow_map

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser that belongs to the vocabulary.
PRETOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 16 << 20
MIN_CHARS, MAX_CHARS_PER_TOKEN = 20, 2.2
#: The base patterns, in the order of their kinds. A match shorter than its limit is dropped.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
WORDS = ("passw", "secret", "token", "key")
#: '=' is a delimiter before and after a string; only as padding, at the end of a value, does it belong to it.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
#: Digests and identifiers: whole-string forms that are no secrets by themselves.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/]+=*|[\d_-]+)\Z")
#: Pieces of an identifier: between separators, and where letters turn into digits or small ones into capitals.
PIECE = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]++|[A-Z]+(?=[A-Z][a-z])|[0-9]++|[+=]")
#: A single run of letters isn't made of words that can be told apart: its tokens decide.
ONE_CASE = re.compile(r"(?:[a-z]+|[A-Z]+)\Z")
#: Characters that are tokenised at once: byte-pair merging takes the square of a run's length.
WINDOW = 256


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read on the driver; its size is bounded."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, per kind leftmost and without overlap, sorted."""
    out = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def identifier(s: str) -> bool:
    """Whether a string is made of words: pieces of two letters or more (any first one), and of at most four digits that
    end at a separator or with the string. One pass, which ends at the first piece that is no such word."""
    for m in PIECE.finditer(s):
        a, b = m.span()
        if s[a] in "+=" or s[a].isdigit() and (b - a > 4 or b < len(s) and s[b] not in "/_-"):
            return False
        if s[a].isalpha() and a > 0 and b - a < (3 if s[a].isupper() and s[b - 1].islower() else 2):
            return False
    return True


def n_tokens(s: str, encode) -> int:
    """Tokens of the whole string, window by window: at most one more a window than at once."""
    return sum(len(encode(s[k : k + WINDOW])) for k in range(0, len(s), WINDOW))


def random_spans(text: str, known: list[tuple[int, int, int]], encode) -> list[tuple[int, int, int]]:
    """Spans of strings with few characters per token; those that overlap a base span (known, sorted) are left to it."""
    out = []
    starts, ends = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not any(map(str.isalpha, s)) or KNOWN.match(s) or not ONE_CASE.match(s) and identifier(s):
            continue
        before = bisect_left(starts, m.end())
        if before and ends[before - 1] > m.start():
            continue
        if len(s) <= MAX_CHARS_PER_TOKEN * n_tokens(s, encode):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of df: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind).

    Whole texts of any length, in linear time; offsets in code points, ends exclusive. Null counts as empty: no spans,
    the digest of the empty string. An empty table gives an empty result, repeated rows repeated results. Narrow: no
    shuffle; the vocabulary, of bounded size, is broadcast. Other columns of df aren't read, so their names can't clash.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()
    made: list = []

    def encode(s: str) -> list[int]:
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding("scan", pat_str=PRETOKENS, mergeable_ranks=ranks.value, special_tokens={}))
        return made[0].encode_ordinary(s)

    def rows(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in x["text"]:
            base = base_spans(text or "")
            every = sorted(base + random_spans(text or "", base, encode))
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return {id_col: x[id_col]} | out

    return arrow_map(df.select(id_col, F.col(text_col).alias("text")), rows, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
