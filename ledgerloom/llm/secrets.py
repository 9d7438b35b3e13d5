"""Secret scans: an Aho-Corasick pass finds keywords, anchored regular expressions run only at hits, and tokens with an
embedded checksum must pass it.

Kinds, in order: assign, access, hex (the base kinds); github, npm (prefix, 30 characters, and the base-62 CRC-32 of
those); jwt (three base64url parts, the first a JSON object with alg). A hexadecimal run has no keyword: it is its own
pattern, searched for directly.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
#: A web token's first part, and the other two.
PART, PARTS = re.compile(r"[A-Za-z0-9_-]++"), re.compile(r"\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
#: How a JSON object's first member begins; the parser's own refusals take time that grows with what lies before.
MEMBER = re.compile(r'\{[ \t\n\r]*+"(?:[^"\\\x00-\x1f]|\\.)*+"[ \t\n\r]*+:')
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "api_key": 0, "apikey": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "eyj": 5}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else changed, so that positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def base62(n: int) -> str:
    out = ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def valid(m: re.Match) -> bool:
    """Whether the last six characters are the CRC-32 of those before."""
    return base62(zlib.crc32(m[1].encode())) == m[2]


class WebTokens:
    """Web tokens of one text: three base64url parts, the first a JSON object with alg. A part is read once, however many
    of its places a token might start at; so is its decoding, which is the same for every fourth place."""

    def __init__(self, text: str) -> None:
        self.text, self.until, self.end = text, 0, None
        self.read: dict[int, tuple[int, bytes, str, bool]] = {}

    def match(self, start: int) -> int | None:
        """The end of the token that starts here, if one does."""
        if start >= self.until:
            self.until = PART.match(self.text, start).end()
            rest = PARTS.match(self.text, self.until)
            self.end = rest and rest.end()
            self.read = {}
        return self.end if self.end and (self.until - start) % 4 != 1 and self.has_alg(start) else None

    def has_alg(self, start: int) -> bool:
        if start % 4 not in self.read:
            part = self.text[start : self.until]
            raw = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
            self.read[start % 4] = start, raw, raw.decode("latin-1"), raw.rstrip(b" \t\n\r").endswith(b"}")
        first, raw, chars, closed = self.read[start % 4]
        at = (start - first) // 4 * 3
        if not closed or not MEMBER.match(chars, at):
            return False
        try:
            head, end = json.JSONDecoder().raw_decode(chars, at)
            raw[at:].decode() if isinstance(head, dict) and "alg" in head else None
        except (ValueError, RecursionError):
            return False
        return isinstance(head, dict) and "alg" in head and not chars[end:].strip(" \t\n\r")


def spans(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, ends exclusive. Matches of a kind don't overlap, the leftmost wins."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in words.iter(lowered(text)))
    free = [0] * len(KINDS)
    tokens = WebTokens(text)
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == 5:
            end = tokens.match(start) if text.startswith("eyJ", start) else None
            if end:
                free[kind] = end
                found.append((start, kind, end))
            continue
        m = (ASSIGN, ACCESS, None, CHECKED, CHECKED)[kind].match(text, start)
        if m is None:
            continue
        if kind == 0:
            keep = len(m[2]) >= 6
        elif kind == 1:
            keep = m.end() - start >= 20
        elif not (keep := valid(m)):
            continue
        free[kind] = m.end()
        if keep:
            found.append((start, kind, m.end()))
    return sorted(found)


def digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by [kind]; overlapping spans become one, named by the first. Of an assignment
    the keyword stays."""
    out, at = [], 0
    for a, k, b in found:
        if k == 0:
            m = ASSIGN.match(text, a)
            a = m.start(2)
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Every row's doc_id, n_assign, n_access, n_hex, base_sha256 and spans; with rewrite, all columns of docs instead,
    text being redacted and n_chars, if there is one, its code points.

    Null and empty texts have no spans (a null stays null when rewritten); ids may be null or repeated; an empty table
    gives an empty result; other columns, whatever their names, are not read, and kept as they are when rewritten. Each
    text is scanned whole and alone, so nothing is shuffled, in time that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = []
            for x in batch.column(1):
                found = spans(x.as_py() or "", words)
                base = [f for f in found if f[1] < 3]
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(digest(base).encode()).hexdigest(), digest(found)))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at, names = batch.schema.get_field_index("text"), batch.schema.names
            texts = [None if (t := x.as_py()) is None else redacted(t, found) if (found := spans(t, words)) else t for x in batch.column(at)]
            cols = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    bound_batches(docs.sparkSession)
    if rewrite:
        rows = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in docs.columns else docs
        return rows.mapInArrow(clean, rows.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {FOUND}")
