"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are always reported. The field then reads the
islands of a text, runs of digits and separators or of characters around an ``@``, and
scores whole candidate segments: how many digits in which groups, which separators, check
digit, octets, what stands before and after. Segments have at most ``MAX_ATOMS`` atoms, so
dynamic programming over atom positions chooses boundaries and types jointly in linear
time. Segments it finds clear of all base spans are added.

Learning: islands whose gold segments are the base spans, plus variants of phone numbers
without their country code; at most ``SAMPLE`` islands, those with the least hashes. That
bounds the model, which is broadcast. Finding is a scalar function of the text.

Defined results: NULL and empty texts have no spans; offsets are code points, ends
exclusive; without any island to learn from only base spans are found; equal texts get
equal spans; very long texts are read in full, in time linear in their length.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from liftspark.llm.texts import free_name, joined, sha256, struct, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind starts a match at the first digit of a run, where the leftmost match is.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SAMPLE = 1500
EPOCHS = 6
MAX_ATOMS = 15
MIN_DIGITS, MAX_DIGITS = 7, 25
CONTEXT = 24  # characters looked at before a segment
NUMERIC = re.compile(r"[0-9+(][0-9\x20().+/-]*+")
AROUND_AT = re.compile(r"[^\s@,;:<>()\[\]\"']{1,64}@[^\s@,;:<>()\[\]\"']{1,128}")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
CUES = ("call", "card", "contact", "email", "fax", "host", "ip", "mail", "mobile", "phone", "server", "tel", "visa")
SPANS = (
    StructType()
    .add("kinds", ArrayType(StringType()))
    .add("starts", ArrayType(IntegerType()))
    .add("ends", ArrayType(IntegerType()))
    .add("n_base", IntegerType())
)
ISLAND = struct("hash long, island string, before string, after string, gold string")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(parts: list) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list:
    """Leftmost matches, found from each ``@`` outwards."""
    out, reach, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > reach and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            reach = m.end()
        at = text.find("@", max(at + 1, reach))
    return out


def base_spans(text: str) -> list:
    """Base matches as (kind, start, end), by start and then by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return ordered(out)


def ordered(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def islands(text: str) -> list:
    """Stretches that may hold personal data as (start, end)."""
    out = []
    if DIGIT.search(text):
        for m in NUMERIC.finditer(text):
            run = m.group().rstrip(" ().+/-")
            if len(run) >= MIN_DIGITS and len(DIGIT.findall(run)) >= MIN_DIGITS:
                out.append((m.start(), m.start() + len(run)))
    if "@" in text:
        out += [m.span() for m in AROUND_AT.finditer(text)]
    return sorted(out)


def _edge(char: str) -> str:
    return "none" if not char else "digit" if char.isdigit() else "letter" if char.isalpha() else "space" if char.isspace() else char


def segment_features(segment: str, before: str, after: str) -> list:
    """Features of a whole candidate segment."""
    groups = re.findall(r"[0-9]+", segment)
    digits = "".join(groups)
    separators = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", segment))))
    cue = re.search(r"([A-Za-z]+)[^A-Za-z]*$", before)
    cue = cue.group(1).lower() if cue else ""
    out = [
        f"n={min(len(digits), 20)}",
        f"sep={separators}",
        f"left={_edge(before[-1:])}",
        f"right={_edge(after[:1])}",
        f"cue={cue if cue in CUES else ''}",
    ]
    if "@" in segment:
        host = segment.rpartition("@")[2]
        labels = host.split(".")
        top = labels[-1]
        out += [f"labels={min(len(labels), 4)}", f"top={'letters' if top.isalpha() and len(top) > 1 else 'other'}"]
        out += [f"empty={any(not x for x in labels)}", f"host={all(re.fullmatch(r'[A-Za-z0-9-]+', x) for x in labels)}"]
    else:
        shape = "-".join(str(min(len(g), 9)) for g in groups[:6])
        out += [f"shape={shape}", f"groups={min(len(groups), 7)}", f"plus={segment[0] == '+'}"]
        out += [f"luhn={14 <= len(digits) <= 19 and luhn(digits)}", f"long={len(digits) > 15}"]
        out += [f"ip={segment.count('.') == 3 and len(groups) == 4 and separators == '.' and octets(groups)}"]
        out += [f"area={bool(re.search(r'[(][0-9]{2,4}[)]', segment))}", f"even={segment.count('(') == segment.count(')')}"]
    return out


def candidates(island: str, before: str, after: str) -> tuple:
    """Spans of the atoms, and segments (first, last + 1, kind, features) an entity may fill."""
    spans = [m.span() for m in ATOM.finditer(island)]
    mail = "@" in island
    out = []
    for i, (start, _) in enumerate(spans):
        digits = signs = 0
        # No number starts inside another word, and no address inside a word.
        if not (island[start].isalnum() if mail else island[start] in "+(0123456789"):
            continue
        for j in range(i, min(i + (4 if mail else 1) * MAX_ATOMS, len(spans))):
            first, end = island[spans[j][0]], spans[j][1]
            signs += first == "@"
            digits += end - spans[j][0] if first.isdigit() else 0
            if signs > 1 or (not mail and (digits > MAX_DIGITS or first.isalpha())):
                break
            if mail and signs:
                fits, kinds = first.isalnum() and (i == 0 or not island[start - 1].isalnum()), KINDS[:1]
            else:
                fits, kinds = not mail and first.isdigit() and digits >= MIN_DIGITS, KINDS[1:]
            if fits:
                left, right = before if start < CONTEXT else "", after if len(island) - end < 2 else ""
                found = segment_features(
                    island[start:end], left + island[max(0, start - CONTEXT) : start], island[end : end + 2] + right
                )
                out += [(i, j + 1, kind, [f"{kind}|{f}" for f in found] + [kind]) for kind in kinds]
    return spans, out


def _logsum(values: list) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _forward(n: int, ending: list, scores: list) -> list:
    alpha = [0.0]
    for j in range(1, n + 1):
        alpha.append(_logsum([alpha[j - 1], *(alpha[i] + scores[s] for i, s in ending[j])]))
    return alpha


def fit(rows: list, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> dict:
    """Weights of maximal conditional likelihood, by gradient steps in a fixed order.

    ``rows`` are (atom count, segments, numbers of the gold segments).
    """
    weights, squares = {}, {}
    for _ in range(epochs):
        for n, segments, gold in rows:
            scores = [sum(weights.get(f, 0.0) for f in s[3]) for s in segments]
            ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for number, (i, j, _, _) in enumerate(segments):
                ending[j].append((i, number))
                starting[i].append((j, number))
            alpha = _forward(n, ending, scores)
            beta = [0.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                beta[i] = _logsum([beta[i + 1], *(beta[j] + scores[s] for j, s in starting[i])])
            for number, (i, j, _, found) in enumerate(segments):
                expected = math.exp(alpha[i] + scores[number] + beta[j] - alpha[n])
                step = (number in gold) - expected
                if abs(step) > 1e-4:
                    for f in found:
                        g = step - decay * weights.get(f, 0.0)
                        squares[f] = squares.get(f, 1e-6) + g * g
                        weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return weights


def decode(island: str, before: str, after: str, weights: dict) -> list:
    """Best segmentation of an island: entities as (kind, start, end) inside it."""
    spans, segments = candidates(island, before, after)
    if not segments:
        return []
    ending = [[] for _ in range(len(spans) + 1)]
    for i, j, kind, found in segments:
        ending[j].append((i, kind, sum(weights.get(f, 0.0) for f in found)))
    best, back = [0.0], [None]
    for j in range(1, len(spans) + 1):
        top, how = best[j - 1], None
        for i, kind, score in ending[j]:
            if best[i] + score > top:
                top, how = best[i] + score, (i, kind)
        best.append(top)
        back.append(how)
    out, j = [], len(spans)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((kind, spans[i][0], spans[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _context(text: str, start: int, end: int) -> tuple:
    return text[max(0, start - CONTEXT) : start], text[end : end + 2]


def added_spans(text: str, base: list, weights: dict) -> list:
    """Entities of the field that are clear of all base spans."""
    if not weights:
        return []
    found = islands(text)
    covered = np.zeros(len(text) if found else 0, bool)
    for _, a, b in base if found else ():
        covered[a:b] = True
    out = []
    for start, end in found:
        for kind, a, b in decode(text[start:end], *_context(text, start, end), weights):
            a, b = start + a, start + b
            if not covered[a:b].any():
                covered[a:b] = True
                out.append((kind, a, b))
    return out


def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Islands with their gold segments as ``kind:start:end`` lists."""
    for batch in batches:
        rows = []
        for key, text in zip(batch["hash"], batch["text"]):
            base = base_spans(text)
            for n, (start, end) in enumerate(islands(text)):
                inside = [(k, a - start, b - start) for k, a, b in base if a >= start and b <= end]
                mixed = (int(key) ^ (n * 0x9E3779B97F4A7C15)) & ((1 << 63) - 1)
                rows.append((mixed, text[start:end][:400], *_context(text, start, end), joined(inside)))
        yield pd.DataFrame(rows, columns=ISLAND.names)


def _gold(spans: list, segments: list, gold: str) -> set:
    marked = {tuple(g.split(":")) for g in gold.split(",") if g}
    return {
        n
        for n, (i, j, kind, _) in enumerate(segments)
        if (kind, str(spans[i][0]), str(spans[j - 1][1])) in marked
    }


def _disjoint(numbers: set, segments: list) -> set:
    """Gold segments without overlap, earlier kinds first."""
    out, taken = set(), []
    for n in sorted(numbers, key=lambda n: (KINDS.index(segments[n][2]), segments[n][0])):
        i, j = segments[n][:2]
        if all(j <= a or i >= b for a, b in taken):
            out.add(n)
            taken.append((i, j))
    return out


def training_rows(sample: list) -> list:
    """Islands as (atoms, segments, gold), with national variants of phone numbers."""
    rows = []
    for island, before, after, gold in sample:
        variants = [(island, gold)]
        short = re.fullmatch(r"\+[0-9]{1,3}\x20(\([0-9]{2,4}\).*)", island)
        if short and gold == f"phone:0:{len(island)}":
            variants.append((short.group(1), f"phone:0:{len(short.group(1))}"))
        for text, marks in variants:
            spans, segments = candidates(text, before, after)
            if segments:
                rows.append((len(spans), segments, _disjoint(_gold(spans, segments, marks), segments)))
    return rows


def train(docs: DataFrame, key: Column, text: Column, sample: int = SAMPLE) -> dict:
    """Weights learned from the bounded sample of islands.

    A histogram of hash buckets gives the bucket up to which there are texts enough, so
    that few more islands than the sample are made and ranked.
    """
    rows = docs.select(F.xxhash64(key.cast("string")).alias("hash"), text.alias("text"))
    rows = rows.filter(F.col("text").rlike("[0-9@]"))
    bucket = F.shiftrightunsigned("hash", 52)  # 4,096 of them
    counts = sorted(rows.groupBy(bucket.alias("b")).count().collect())
    reached, last = 0, -1
    for last, n in counts:
        reached += n
        if reached >= sample:
            break
    found = rows.filter(bucket <= last).mapInPandas(examples, ISLAND)
    chosen = found.orderBy("hash", "island", "before").limit(sample).drop("hash").collect()
    return fit(training_rows([tuple(r) for r in chosen]))


def finder(spark: SparkSession, weights: dict):
    """Scalar function text -> struct of spans."""
    shared = spark.sparkContext.broadcast(weights)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                found = ordered(base + [(k, a, b) for k, a, b in added_spans(text, base, shared.value)])
                rows.append((*(map(list, zip(*found)) if found else ([], [], [])), len(base)))
            yield pd.DataFrame(rows, columns=SPANS.names)

    return F.pandas_udf(find, SPANS)


DIGEST = struct("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


@F.pandas_udf(DIGEST)
def digest(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    rows = []
    for text, kinds, starts, ends, n_base in zip(texts, *(found[c] for c in SPANS.names)):
        every = list(zip(kinds, starts, ends))
        base = every if len(every) == n_base else base_spans(text)
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        rows.append((*counts, sha256(joined(base)), joined(every), len(every) - int(n_base)))
    return pd.DataFrame(rows, columns=DIGEST.names)


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
    out = []
    for text, kinds, starts, ends in zip(texts, found["kinds"], found["starts"], found["ends"]):
        if isinstance(text, str):
            parts, reach = [], 0
            for kind, a, b in zip(kinds, starts, ends):
                if a >= reach:
                    parts += [text[reach:a], f"[{kind.upper()}]"]
                reach = max(reach, b)
            text = "".join(parts) + text[reach:]
        out.append(text)
    return pd.Series(out, dtype=object)


def mask_personal(docs: DataFrame, weights: dict) -> DataFrame:
    """Documents with personal data replaced by its kind, in their own columns only."""
    name = free_name(docs, "_personal")
    found = docs.withColumn(name, finder(docs.sparkSession, weights)(F.col("text")))
    return found.withColumn("text", _masked(F.col("text"), F.col(name))).drop(name)


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    find = finder(spark, train(docs, F.col("doc_id"), F.col("text")))
    found = docs.withColumn("s", find(F.col("text")))
    return found.select("doc_id", digest("text", "s").alias("d")).select("doc_id", "d.*")
