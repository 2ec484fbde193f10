"""Secret scans with dictionary-primed zstandard novelty.

Three base patterns (assignments, access keys, long hexadecimal runs) are always reported.
Beyond them, a string after a sensitive word is a candidate, and its novelty is the number
of compressed bytes it adds to the text around it, for a compressor primed with common
identifiers: a word the text or the dictionary knows costs next to nothing, a random key
nearly its length. Candidates that stay incompressible are reported as ``novel``.

That cost is read off two frames that share one table of codes, so among source code, where
literals are cheap, a short random key may pass for known, and a long word among prose for new. A
candidate with an unbroken run of letters and digits is therefore measured in a second way: the
dictionary takes in the surroundings, and the run alone is compressed. It is reported if it stays
incompressible and its letters do not follow each other as in words; this is the only measure for
runs of letters alone or of digits alone.

A key written twice is no better known for it: what the surroundings share with the
candidate is taken out before it is measured, and every further occurrence of a reported key
in the text is reported too, near a sensitive word or not. Only identifiers, whose letters
follow each other as in words, are known by their own repeats.

A scalar function of the text: no shuffle, one Arrow batch in memory. Cheap byte searches
leave most texts out before any pattern runs; they never drop one that could match.

Defined results: NULL and empty texts have no spans; offsets are code points, ends
exclusive; a base span covers the whole match; kinds may overlap each other, novel spans
overlap no base span; equal texts get equal spans; very long texts are scanned in full.
"""

import bisect
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from liftspark.llm.texts import free_name, joined, sha256, struct, table, utf8

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|secret|token|credential|authorization|bearer"
    r"|(?:api|access|private|signing|encryption)[_-]?key",
    re.I | re.A,
)
HINTS = (b"passw", b"passphrase", b"secret", b"token", b"credential", b"authorization", b"bearer", b"key")
MIN_CANDIDATE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
REACH = 48  # code points between a sensitive word and its candidate
AROUND = 512  # code points of surrounding text on either side
MIN_NOVELTY = 0.75  # compressed bytes added for each byte of the candidate
MIN_BITS = 4.0  # bits a character by the letter pairs of the identifiers; words cost less
# The same for an unbroken run, which is read against a dictionary of its surroundings. Runs of one
# kind need more: a long word of another language has letter pairs that are rare here.
MIN_RUN_BITS, MIN_PLAIN_RUN_BITS = 4.5, 5.0
RUN = re.compile(rf"[A-Za-z0-9]{{{MIN_CANDIDATE},}}")
IDENTIFIERS = (
    "access account address admin algorithm api app application argument array assert async auth"
    " authorization await backend base64 bearer boolean branch buffer bytes cache callback certificate"
    " class client cloud cluster code column commit config configuration connection const content"
    " context cookie count create credential data database date debug default define delete deploy"
    " development dictionary directory document domain encode encryption endpoint engine environment"
    " error event example exception export expires file filter float format from function gateway"
    " global group hash header host hostname http https id identifier import include index input"
    " instance int integer interface json key lambda length library license list local login logger"
    " main manager map message method model module name network node null number object option output"
    " package page parameter parse passphrase password path placeholder pointer policy port private"
    " process production project property protocol provider proxy public query queue read record"
    " refresh region registry release repository request require reset resource response result return"
    " role root route schema scope script secret security select self server service session setting"
    " signature signing socket source staging static status storage stream string struct system table"
    " target template test thread timestamp token type undefined update upload url user username utf-8"
    " value variable vector version void webhook worker write xxxxxxxxxxxxxxxx 0000000000000000"
    " 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890"
)
_TO_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
SPANS = (
    StructType()
    .add("kinds", ArrayType(StringType()))
    .add("starts", ArrayType(IntegerType()))
    .add("ends", ArrayType(IntegerType()))
)


def compressor():
    """Level 3 with the identifier dictionary."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed)


def base_spans(text: str, data: bytes) -> list:
    """Matches of the base patterns as (kind, start, end)."""
    out = []
    low = data.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= MIN_ACCESS]
    if b"h" * MIN_HEX in data.translate(_TO_HEX):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _letters(text: str) -> str:
    return "".join(c if "a" <= c <= "z" else " " for c in text.lower())


_WORDS = _letters(IDENTIFIERS[: IDENTIFIERS.index(" xxxx")])  # without the fillers
_FIRST = Counter(_WORDS)
_PAIRS = Counter(zip(_WORDS, _WORDS[1:]))


def bits(token: str) -> float:
    """Bits a character by the letter pairs of the identifiers; all else is a blank."""
    low = _letters(token)
    costs = (math.log2((_FIRST[a] + 5.4) / (_PAIRS[a, b] + 0.2)) for a, b in zip(" " + low, low))
    return sum(costs) / len(token)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def added(around: str, candidate: str, primed) -> float:
    """Compressed bytes the candidate adds to its surroundings, per byte."""
    known, new = utf8(around), utf8(candidate)
    return (len(primed.compress(known + new)) - len(primed.compress(known))) / len(new)


def _unshared(wide: str, start: int, end: int, grams: set) -> str:
    """The code points from start to end that lie in none of the grams of the wider stretch."""
    out, clear = [], start
    for i in range(len(wide) - MIN_CANDIDATE + 1):
        if wide[i : i + MIN_CANDIDATE] in grams:
            out.append(wide[clear : min(i, end)])
            clear = max(clear, i + MIN_CANDIDATE)
    return "".join(out) + wide[clear:end]


def _around(text: str, start: int, end: int) -> str:
    """The surroundings of a candidate without what they share with it."""
    candidate = text[start:end]
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    grams = {candidate[i : i + MIN_CANDIDATE] for i in range(len(candidate) - MIN_CANDIDATE + 1)}
    more = MIN_CANDIDATE - 1  # a copy may reach beyond the surroundings
    cut = max(0, low - more)
    before = _unshared(text[cut:start], low - cut, start - cut, grams)
    return before + _unshared(text[end : high + more], 0, high - end, grams)


def novelty(text: str, start: int, end: int, primed) -> float:
    """Compressed bytes the candidate adds to its surroundings without its copies, per byte."""
    candidate = text[start:end]
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    plain = added(text[low:start] + text[end:high], candidate, primed)
    if plain >= MIN_NOVELTY or bits(candidate) < MIN_BITS:
        return plain
    return max(plain, added(_around(text, start, end), candidate, primed))


def _random_like(run: str) -> bool:
    return bits(run) >= (MIN_RUN_BITS if _mixed(run) else MIN_PLAIN_RUN_BITS)


def run_novelty(text: str, start: int, end: int) -> float:
    """Compressed bytes of a candidate's unbroken runs for a dictionary of the identifiers and its
    surroundings, per byte: the highest of the runs that do not look like words, 0 without any."""
    runs = [r for r in RUN.findall(text, start, end) if _random_like(r)]
    if not runs:
        return 0.0
    known = utf8(f"{IDENTIFIERS} {_around(text, start, end)}")
    shared = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bare = zstandard.ZstdCompressor(
        level=3, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    frame = len(bare.compress(b""))
    return max((len(bare.compress(r.encode())) - frame) / len(r) for r in runs)


def is_novel(text: str, start: int, end: int, primed) -> bool:
    """Whether a candidate stays incompressible by one of the two measures."""
    if _mixed(text[start:end]) and novelty(text, start, end, primed) >= MIN_NOVELTY:
        return True
    return run_novelty(text, start, end) >= MIN_NOVELTY


def _keys(token: str) -> set:
    """A reported token, and the key in it without the marks and the name around it."""
    parts = {p.strip("/_.=+-") for p in token.split("=")}
    named = {p for p in parts if _mixed(p) and bits(p) >= MIN_BITS}
    bare = {token.rstrip("."), token.strip("_.=-"), token.strip("/_.=+-")}
    return {token} | {k for k in named | bare if len(k) >= MIN_CANDIDATE}


def repeats(text: str, runs: list, tokens: set) -> list:
    """Where the keys of the tokens lie in the runs, the longest at each place."""
    starts = {}
    for key in sorted(set().union(*map(_keys, tokens)), key=lambda k: (-len(k), k)):
        starts.setdefault(key[:MIN_CANDIDATE], []).append(key)
    out = []
    for a, b in runs:
        at = a
        while at <= b - MIN_CANDIDATE:
            keys = starts.get(text[at : at + MIN_CANDIDATE], ())
            size = next((len(k) for k in keys if text.startswith(k, at, b)), 0)
            if size:
                out.append((at, at + size))
            at += size or 1
    return out


def novel_spans(text: str, data: bytes, base: list, primed) -> list:
    """Incompressible candidates after a sensitive word, and their copies, outside the base spans.

    A candidate is a run of key characters, or what of it follows the word.
    """
    low = data.lower()
    if not any(w in low for w in HINTS):
        return []
    words = [m.end() for m in SENSITIVE.finditer(text)]
    runs = [m.span() for m in CANDIDATE.finditer(text)] if words else []
    ends = [end for _, end in runs]
    found = {}  # end of a run to where its candidate starts: after the last word before it
    for word in words:
        at = bisect.bisect_left(ends, word + MIN_CANDIDATE)
        while at < len(runs) and runs[at][0] <= word + REACH:
            found[runs[at][1]] = max(runs[at][0], word)
            at += 1
    covered = np.zeros(len(text) if found else 0, bool)
    for _, a, b in base if found else ():
        covered[a:b] = True
    out = []
    for end, start in sorted(found.items()):
        if not covered[start:end].any() and is_novel(text, start, end, primed):
            out.append(("novel", start, end))
    for _, a, b in out:
        covered[a:b] = True
    copies = repeats(text, runs, {text[a:b] for _, a, b in out}) if out else []
    return out + [("novel", a, b) for a, b in copies if not covered[a:b].any()]


def spans(text, primed) -> list:
    """All spans of a text, by start and then by kind."""
    if not isinstance(text, str) or not text:
        return []
    data = utf8(text)
    base = base_spans(text, data)
    found = base + novel_spans(text, data, base, primed)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.pandas_udf(SPANS)
def _secret_spans(texts: pd.Series) -> pd.DataFrame:
    primed = compressor()
    rows = [tuple(map(list, zip(*found))) if (found := spans(t, primed)) else ([], [], []) for t in texts]
    return pd.DataFrame(rows, columns=SPANS.names)


def secret_spans(text: Column) -> Column:
    """Kinds, starts and ends of the secrets in a text."""
    return _secret_spans(text)


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
    return pd.Series([mask(t, a, b) for t, a, b in zip(texts, found["starts"], found["ends"])], dtype=object)


def mask(text, starts, ends, label: str = "[SECRET]"):
    """The text with every span replaced by a label; overlapping spans by one."""
    if not isinstance(text, str) or not len(starts):
        return text
    out, reach = [], 0
    for a, b in sorted(zip(starts, ends)):
        if a >= reach:
            out += [text[reach:a], label]
        reach = max(reach, b)
    return "".join(out) + text[reach:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Documents with secrets masked in the text, in their own columns only."""
    name = free_name(docs, "_secrets")
    found = docs.withColumn(name, secret_spans(F.col("text")))
    return found.withColumn("text", _masked(F.col("text"), F.col(name))).drop(name)


DIGEST = struct("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


@F.pandas_udf(DIGEST)
def digest(found: pd.DataFrame) -> pd.DataFrame:
    """Counts, hash of the base spans, and all spans as text."""
    rows = []
    for kinds, starts, ends in found[SPANS.names].itertuples(index=False):
        every = list(zip(kinds, starts, ends))
        n = {k: sum(s[0] == k for s in every) for k in KINDS}
        base = joined(s for s in every if s[0] != "novel")
        rows.append((n["assign"], n["access"], n["hex"], sha256(base), joined(every), n["novel"]))
    return pd.DataFrame(rows, columns=DIGEST.names)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secret_spans(F.col("text")).alias("s"))
    return found.select("doc_id", digest(F.col("s")).alias("d")).select("doc_id", "d.*")
