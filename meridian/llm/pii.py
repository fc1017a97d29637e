"""Information-theoretic sanitisation.

Fixed patterns find personal data, and long strings that carry much information are taken for secrets.
The corpus then tells which other terms give such an entity away. Entities have levels: the value
itself, what it has in common with others (the domain of an address, a network, an issuer, an area) and
its kind. A term near an entity discloses it on some level if knowing the term tells much about the
entity and leaves little unknown, in bits that do not depend on the corpus's size. Disclosing terms are
generalised to their kind, or removed where they have none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, discard, filter_bits, marks, row_key, sized, sliced, table, texts, tidy

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
#: Words on each side of an entity that count as near it; texts that a term is taken to be in beyond
#: those counted; bits about the entity that a term may leave open, and that it has to tell.
WINDOW, SMOOTHING, LEFT, TOLD = 4, 0.25, 0.5, 3.0
#: A secret's least number of characters, of digits and of letters, and of bits by its own characters' frequencies.
SECRET_CHARS, SECRET_MIX, SECRET_BITS = 20, 4, 64.0
#: Words that a worker remembers; code points of a stretch whose words it lists at once; numbers that workers get
#: one by one, 8 MB, beyond which they get a map alone.
_HELD, _SLAB, MOST_EXACT = 150_000, 1 << 20, 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digits before a place cannot start another match where the run's start failed, so runs start matches
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACE = re.compile(r"\s")
_SECRET = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SECRET_CHARS},}}+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted domain, found from each ``@`` outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not any(map(text.__contains__, "0123456789")):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_part, m.groups())):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings of letters and digits mixed that carry much information, outside the base spans."""
    out = []
    for m in _SECRET.finditer(text):
        counts, n = Counter(m.group()), m.end() - m.start()
        digits = sum(k for c, k in counts.items() if c.isdigit())
        letters = sum(k for c, k in counts.items() if c.isalpha())
        if min(digits, letters) >= SECRET_MIX and sum(k * math.log2(n / k) for k in counts.values()) >= SECRET_BITS:
            if not any(a < m.end() and m.start() < b for _, a, b in base):
                out.append((SECRET, *m.span()))
    return out


def levels(kind: str, text: str) -> list[str]:
    """Names of an entity from its value to its kind, without what differs between spellings of one value."""
    if kind == "email":
        value = text.lower()
        own = [value, value[value.index("@") :]]
    elif kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        own = [".".join(parts[:i]) for i in (4, 3, 2)]
    elif kind in ("card", "phone"):
        digits = re.sub("[^0-9]", "", text)
        own = [digits, digits[: 6 if kind == "card" else 4]]
    else:
        own = [text]
    return [f"{kind}:{i}:{value}" for i, value in enumerate(own)] + [kind]


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def _words_before(text: str, start: int, window: int) -> list[re.Match[str]]:
    """The last ``window`` words before a place, from stretches that grow until they hold one more, as the first may be cut."""
    size = 64 * window
    while True:
        low = max(0, start - size)
        found = list(_WORD.finditer(text, low, start))
        if low == 0 or len(found) > window:
            return found[-window:]
        size *= 2


def nearby(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> set[tuple[int, int]]:
    """``(entity, term)`` of the words within ``window`` words of each entity, on all levels of it."""
    out: set[tuple[int, int]] = set()
    blocked = sorted((a, b) for _, a, b in spans)
    heads = [a for a, _ in blocked]
    for kind, start, end in spans:
        # words are taken outwards, so a long text costs what its entities cost
        left = _words_before(text, start, window)
        right = islice(_WORD.finditer(text, end), window)
        names = [_hash(name) for name in levels(kind, text[start:end])]
        for m in (*left, *right):
            i = bisect_left(heads, m.end()) - 1
            if i < 0 or blocked[i][1] <= m.start():  # not inside an entity
                term = _hash(m.group().lower())
                out.update((name, term) for name in names)
    return out


def _pairs(docs: DataFrame, window: int) -> DataFrame:
    """``entity, term, source, words`` of texts with entities; source is a hash of the whole text.

    A row for each entity, level and term near it; one without a term for each entity and level; and one
    without an entity for the text itself, with hashes of all its words. Copies repeat a text's rows
    where they are in different tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in sliced(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = base + secret_spans(text, base)
                source = _hash(text) if spans else 0
                if not spans or source in met:
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(source)
                rows += [(_hash(e), None, source, None) for e in {x for k, a, b in spans for x in levels(k, text[a:b])}]
                rows += [(e, t, source, None) for e, t in nearby(text, spans, window)]
                rows.append((None, None, source, list({_hash(w.lower()) for part in _stretches(text) for w in set(_WORD.findall(part))})))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["entity", "term", "source", "words"])

    return texts(docs).select("text").mapInArrow(tidy(run), "entity long, term long, source long, words array<long>")


@dataclass
class Known:
    """Which of a table's numbers a worker knows: a bit for each, and the numbers themselves where they are few enough.
    Without these, numbers that share a bit pass as well, and an exact join has to follow."""

    bits: np.ndarray
    exact: np.ndarray | None

    def __contains__(self, number: int) -> bool:
        slot = number % (8 * len(self.bits))
        if not self.bits[slot >> 3] >> (slot & 7) & 1:
            return False
        if self.exact is None:
            return True
        at = int(np.searchsorted(self.exact, number))
        return at < len(self.exact) and int(self.exact[at]) == number


def _known(terms: DataFrame) -> Known:
    """Of a table with a long ``term`` and as many rows as there are terms."""
    n = terms.count()
    if n <= MOST_EXACT:
        numbers = np.sort(np.array([r[0] for r in terms.select("term").collect()], np.int64))
        bits = np.zeros(sized(16 * n) // 8, np.uint8)
        slots = numbers % (8 * len(bits))
        np.bitwise_or.at(bits, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
        return Known(bits, numbers)
    size = sized(16 * n)
    return Known(filter_bits(terms.select(F.pmod("term", F.lit(size)).alias("slot")), size), None)


class Terms:
    """Which words of a text are known terms; a worker remembers a bounded number of words."""

    def __init__(self, known: Known) -> None:
        self.known, self.seen, self.named = known, set(), set()

    def of(self, text: str) -> set[str]:
        found: set[str] = set()
        for part in _stretches(text):
            words = set(_WORD.findall(part))
            if len(self.seen) > _HELD:
                self.seen, self.named = set(), set()
            self.named |= {w for w in words - self.seen if _hash(w.lower()) in self.known}
            self.seen |= words
            found |= words & self.named
        return found

    def places(self, text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
        """``(term, start, end)`` of the known words, outside ``spans``."""
        found = {w: _hash(w.lower()) for w in self.of(text)}
        if not found:
            return []
        blocked = sorted((a, b) for _, a, b in spans)
        heads = [a for a, _ in blocked]
        out = []
        for m in _WORD.finditer(text):
            number = found.get(m.group())
            if number is not None:
                i = bisect_left(heads, m.end()) - 1
                if i < 0 or blocked[i][1] <= m.start():
                    out.append((number, m.start(), m.end()))
        return out


def _stretches(text: str) -> Iterator[str]:
    """Stretches of bounded size, cut at white space, so that no word is cut."""
    at = 0
    while len(text) - at > _SLAB:
        m = _SPACE.search(text, at + _SLAB)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _frequencies(docs: DataFrame, terms: Known, repeated: Known) -> DataFrame:
    """``term, documents``: distinct texts that hold each known term.

    Repeated texts move with their hash, once a task; the others are summed by task before they move.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    copies = docs.sparkSession.sparkContext.broadcast(repeated)

    def batch_of(terms: list[int], sources: list[int | None], ns: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (terms, sources, ns)], ["term", "source", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        known = Terms(shared.value)
        met: set[int] = set()
        for batch in sliced(batches):
            terms, sources = [], []
            for text, source in zip(batch.column("text").to_pylist(), batch.column("source").to_pylist(), strict=True):
                again = source in copies.value
                if again:
                    if source in met:
                        continue
                    if len(met) > 200_000:
                        met.clear()
                    met.add(source)
                numbers = {_hash(w.lower()) for w in known.of(text)}
                if again:
                    terms += numbers
                    sources += [source] * len(numbers)
                else:
                    counts.update(numbers)
            if terms:
                yield batch_of(terms, sources, [1] * len(terms))
            if len(counts) > 200_000:
                yield batch_of(list(counts), [None] * len(counts), list(counts.values()))
                counts = Counter()
        yield batch_of(list(counts), [None] * len(counts), list(counts.values()))

    found = texts(docs).select("text", F.xxhash64("text").alias("source")).mapInArrow(tidy(run), "term long, source long, n long")
    once = found.groupBy("term", "source").agg(F.when(F.col("source").isNull(), F.sum("n")).otherwise(F.lit(1)).alias("n"))
    return once.groupBy("term").agg(F.sum("n").alias("documents"))


def disclosing_terms(docs: DataFrame, window: int = WINDOW, smoothing: float = SMOOTHING, left: float = LEFT, told: float = TOLD) -> DataFrame:
    """``term``: hashes of the terms that disclose some entity on some level.

    With N distinct texts, of which d hold the entity, t the term, and c both near each other, the
    term leaves ``log2((t + smoothing) / c)`` bits of the entity's ``log2(N / d)`` open. That must be at
    most ``left``, and what it tells, the rest, at least ``told``: so t is at most
    ``c min(2^left, N / d 2^told) - smoothing``, and the best such bound of a term decides. Texts count
    once however often they are copied, and an entity of a single text can be disclosed; one that
    stands in more than about an eighth of all texts is no news.
    """
    near = table(_pairs(docs, window), "near")
    joint = near.where("entity is not null").select("entity", "term", "source").distinct().groupBy("entity", "term").agg(F.count("*").alias("c"))
    alone = joint.where("term is null").select("entity", F.col("c").alias("d"))
    copies = table(texts(docs).groupBy(F.xxhash64("text").alias("source")).agg(F.count("*").alias("n")), "texts")
    n = float(copies.count())
    bound = F.col("c") * F.least(F.lit(2.0**left), F.lit(n) / (F.col("d") * F.lit(2.0**told))) - F.lit(float(smoothing))
    bounds = joint.where("term is not null").join(alone, "entity").select("term", "c", bound.alias("most"))
    # most terms stand in more of the texts with entities alone, and need no counting in the others
    own = near.where("entity is null").dropDuplicates(["source"]).select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("own"))
    likely = bounds.where("c <= most").groupBy("term").agg(F.max("most").alias("most")).join(own, "term").where("own <= most")
    candidates = table(likely.select("term", "most"), "candidates")
    again = table(copies.where("n > 1").select(F.col("source").alias("term")), "repeated")
    known = candidates.join(_frequencies(docs, _known(candidates), _known(again)), "term")
    found = table(known.where("documents <= most").select("term"), "disclosing")
    discard(near, copies, candidates, again)
    return found


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def _places(docs: DataFrame, terms: Known, every: bool) -> DataFrame:
    """``row, doc_id, base, words``: base spans and secrets, and the places of known words; of every row, or only of
    those with such words."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    any_bit = bool(terms.bits.any())
    place = [("start", pa.int64()), ("end", pa.int64())]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), *place])), pa.list_(pa.struct([("term", pa.int64()), *place]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(shared.value)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for row, doc, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text")), strict=True):
                spans = base_spans(text)
                spans += secret_spans(text, spans)
                words = known.places(text, spans) if any_bit else []
                if every or words:
                    rows.append((row, doc, [{"kind": k, "start": a, "end": b} for k, a, b in spans], [{"term": t, "start": a, "end": b} for t, a, b in words]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], ["row", "doc_id", "base", "words"])

    numbered = texts(docs).withColumn("row", row_key())
    return numbered.mapInArrow(tidy(run), f"row string, doc_id long, base {_SPAN}, words array<struct<term:long,start:long,end:long>>")


def _exact(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``row, doc_id, terms``: the places of words that are disclosing terms indeed."""
    words = found.where("size(words) > 0").select("row", "doc_id", F.explode("words").alias("w")).select("row", "doc_id", "w.*").join(terms, "term")
    return words.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))


def find_spans(docs: DataFrame, window: int = WINDOW, smoothing: float = SMOOTHING, left: float = LEFT, told: float = TOLD) -> DataFrame:
    """``doc_id, base, terms``: base spans and secrets, and disclosing spans, of every row.

    Only rows with a known word are joined with the terms, which settles what a map alone cannot.
    """
    terms = disclosing_terms(docs, window, smoothing, left, told)
    found = table(_places(docs, _known(terms), True), "spans")
    certain = _exact(found, terms).drop("doc_id")
    return found.join(certain, "row", "left").select("doc_id", "base", F.coalesce("terms", F.array().cast("array<struct<start:long,end:long>>")).alias("terms"))


def scan(docs: DataFrame, window: int = WINDOW, smoothing: float = SMOOTHING, left: float = LEFT, told: float = TOLD) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_terms, n_spans``.

    Null and empty texts have no spans and the digest of the empty string. Repeated rows each get a
    row. Very long texts are searched whole, their words a stretch at a time. Extra columns are
    ignored; an empty table gives no rows.
    """
    found = find_spans(docs, window, smoothing, left, told)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("base", lambda x: x["kind"] != SECRET), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    every = F.array_join(F.concat(F.transform("base", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), F.transform("terms", lambda x: F.concat_ws(":", F.lit(TERM), x["start"].cast("string"), x["end"].cast("string")))), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"),
        count(SECRET).alias("n_secret"), F.size("terms").cast("long").alias("n_terms"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"),
    )


def clean(text: str, terms: list[tuple[int, int]]) -> str:
    """Entities become their kind in brackets; of overlapping ones the first stays. Disclosing terms with a
    digit or a capital are generalised to ``[number]`` or ``[name]``, others are removed. What a removal
    brings together is cleaned as well, so that no personal data is left to find."""
    base = base_spans(text)
    spans = [(a, b, f"[{k}]") for k, a, b in base + secret_spans(text, base)]
    for a, b in terms:
        word = text[a:b]
        spans.append((a, b, "[number]" if any(map(str.isdigit, word)) else "[name]" if word[:1].isupper() else ""))
    while spans:
        out, at = [], 0
        for a, b, mark in sorted(spans, key=lambda m: (m[0], -m[1])):
            if a >= at:
                out += [text[at:a], mark]
                at = b
            elif b > at:  # the rest of an overlapping span goes as well
                at = b
        text = "".join([*out, text[at:]])
        base = base_spans(text)
        spans = [(a, b, f"[{k}]") for k, a, b in base + secret_spans(text, base)]
    return text


def sanitise(docs: DataFrame, window: int = WINDOW, smoothing: float = SMOOTHING, left: float = LEFT, told: float = TOLD) -> DataFrame:
    """``docs`` with cleaned texts: all rows and columns stay, null texts stay null and empty ones empty.

    Rows without any disclosing term are cleaned where they are; only those with one are joined with its
    places, by doc_id and a 128-bit digest of the text. Rows without a doc_id always are. Repeated rows
    are cleaned alike; extra columns may have any name but ``__row`` and ``__terms``; an empty table stays empty.
    """
    terms = disclosing_terms(docs, window, smoothing, left, told)
    exact = table(_exact(_places(docs, _known(terms), False), terms), "places")
    named = marks(table(exact.where("doc_id is not null").select("doc_id").distinct(), "named"))
    own = exact.select(F.col("row").alias("__row"), F.col("terms").alias("__terms"))
    rest = named.split(docs, True).unionByName(docs.where("doc_id is null")).withColumn("__row", row_key()).join(own, "__row", "left")
    sure = named.split(docs, False).where("doc_id is not null").withColumn("__terms", F.lit(None).cast(own.schema["__terms"].dataType))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = zip(batch.column("text").to_pylist(), batch.column("__terms").to_pylist(), strict=True)
            new = [t and clean(t, [(w["start"], w["end"]) for w in terms or ()]) for t, terms in found]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            kept[at] = pa.array(new, kept[at].type)
            yield pa.RecordBatch.from_arrays(kept, batch.schema.names[:-1])

    names = columns(docs)
    return sure.select(*names, "__terms").unionByName(rest.select(*names, "__terms")).mapInArrow(tidy(run), docs.schema)
