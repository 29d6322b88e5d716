"""Benchmark decontamination by templates.

A text becomes a template: words in lower case without their punctuation,
numbers as <num>, units after a number as <unit>, and capitalised words inside
a sentence as <name>, neighbours merged. Whether the capitalised word that opens
a sentence is a name can't be seen, so a text has two forms: in the first such
words are plain, in the second they are names unless they are among the common
``OPENERS``. Windows of both forms of a document meet those of both forms of an
item, and each pair of forms is judged on its own. Windows with fewer plain
words than half are left out, as chance matches them; an item that has no other
in its first form (sums, tables of numbers, lists of names) is matched in a
third form too, its words, numbers and units by value. Windows of ``WINDOW`` template tokens
are hashed; documents' windows meet the benchmark's in a join on the hash, and
the values behind the placeholders (the slots) tell whether a match is the
item itself or the item with other parameters: along one alignment of document
and item, equal values in the item must stand for equal values in the
document. A word put in or left out moves the rest of a copy to another
alignment, so alignments at most ``DRIFT`` apart are chained and count together,
the larger first, each that agrees with the values so far; the windows that
only the edit between two of them broke count too. A document is contaminated
by an item if consistent windows of one alignment or chain cover ``COVERAGE``
of the item's, or ``RUN`` of them.

Documents' windows go to the join only where a bitmap of the benchmark's
hashes says that they may have a partner. The bitmap has 2**22 bits whatever
the size of the benchmark; a larger benchmark lets more windows pass and
changes no result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, slices, written

WINDOW = 8
#: Items shorter than this many tokens are told from chance only where they are the whole text; windows of templates need as many plain words as half their length.
SHORTEST = 4
COVERAGE = 0.5
RUN = 18
#: Words that may be put in or left out in one place of a copy.
DRIFT = 4
BITS = 22

# Units of measure.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year km/h mph m/s kw kwh w v a hz kb mb gb tb % $ € £ usd eur gbp dollars dollar cents cent euros euro °c °f degrees percent meters metres kilometers kilometres miles inches feet pounds grams kilograms liters litres".split())
# Words that open sentences and are no names.
OPENERS = frozenset("a an the this that these those there here it its he she they we you i his her their our your my if when whenever while then what which who whom whose why where how and but or nor so because since although though after before during until once in on at of for from to with without by as is are was were do does did has have had can could will would shall should may might must not no each every all both some any one two three four five six seven eight nine ten find calculate compute determine solve suppose consider let given assume show prove explain answer question problem solution note now today yesterday tomorrow finally however therefore also".split())
PLAIN, NAMED, VALUES = 0, 1, 2
NUM, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<num>", "<unit>", "<name>"))
SLOTS = np.array([NUM, UNIT, NAME], np.uint64)
_BASE = 0x9E3779B97F4A7C15

_NUMBER = re.compile(r"^[+-]?[$€£]?(\d[\d.,:/]*)(.*)$", re.DOTALL)
_CORE = re.compile(r"^[^\w$€£%+-]*(.*?)[^\w$€£%°]*$", re.DOTALL)
_WORDY = re.compile(r"\w", re.UNICODE)
_STOP = re.compile(r"[.!?]")


@dataclass(frozen=True)
class Token:
    """What a token is, whatever stands around it."""

    codes: tuple[tuple[int, str], ...]  # (code, value of a slot or empty)
    capital: bool  # a name, if no sentence begins here
    after: bool  # a sentence begins after it
    unit: bool  # a unit, if a number stands before


def classify(raw: str) -> Token:
    core = _CORE.match(raw)[1]
    after = bool(_STOP.search(raw[raw.rfind(core) + len(core) :] if core else raw))
    if not _WORDY.search(core) and core not in UNITS:
        return Token((), False, after, False)
    if m := _NUMBER.match(core):
        number, rest = m[1].rstrip(".,:/"), m[2].lower()
        if rest in UNITS:
            return Token(((int(NUM), number), (int(UNIT), rest)), False, after, False)
        if not _WORDY.search(rest):
            return Token(((int(NUM), number),), False, after, False)
    word = core.strip("$€£%+-°") or core
    low = word.lower()
    return Token(((xxhash.xxh64_intdigest(low), ""),), word[0].isupper() and not (len(word) > 1 and word.isupper()), after, low in UNITS or core.lower() in UNITS)


@dataclass
class Templates:
    """Texts one after the other as template codes; starts of each text and
    the end of the last. ``token`` is where a code's text token stands."""

    codes: np.ndarray
    starts: np.ndarray
    token: np.ndarray
    words: pa.Array
    ids: np.ndarray
    part: np.ndarray

    def raw(self, token: int) -> str:
        return self.words[self.ids[token]].as_py()

    def value(self, at: int) -> str:
        """What stands behind a slot."""
        code = int(self.codes[at])
        if code == NAME:
            first, last = self.token[at], self.token[at + 1] if at + 1 < len(self.token) else len(self.ids)
            names = []
            for t in range(first, last):
                seen = classify(self.raw(t))
                if seen.codes and (t == first or seen.capital):
                    names.append(_CORE.match(self.raw(t))[1].lower())
                elif seen.codes:
                    break
            return " ".join(names)
        raw = self.raw(self.token[at])
        return classify(raw).codes[self.part[at]][1] or _CORE.match(raw)[1].lower()


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of each text's bytes."""
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if buffers[2] else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    begin = offsets[:-1] - offsets[0]
    power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, 0x100000001B3, np.uint64), out=power[1:])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(begin, size)], out=total[1:])
    h = (total[begin + size] - total[begin]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(31)


def _classified(words: pa.Array) -> dict[str, np.ndarray]:
    """What ``classify`` says of each of some distinct tokens, as columns; only
    those that begin like numbers are looked at one by one."""
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    core = pc.replace_substring_regex(pc.replace_substring_regex(words, r"^[^\pL\pN_$€£%+-]+", ""), r"[^\pL\pN_$€£%°]+$", "")
    units = pa.array(sorted(UNITS), pa.large_string())
    wordy = flag(pc.match_substring_regex(core, r"[\pL\pN_]"))
    empty = ~wordy & ~flag(pc.is_in(core, value_set=units))
    bare = pc.utf8_trim(core, "$€£%+-°")
    word = pc.if_else(pc.equal(bare, ""), core, bare)
    low = pc.utf8_lower(word)
    shout = flag(pc.equal(pc.utf8_upper(word), word)) & (pc.utf8_length(word).to_numpy(zero_copy_only=False) > 1)
    first, second = _hashes(low), np.zeros(len(words), np.uint64)
    first[empty] = 0
    found = {
        "empty": empty,
        "value": _hashes(pc.utf8_lower(core)),
        "capital": flag(pc.match_substring_regex(word, r"^\p{Lu}")) & ~shout & ~empty,
        "other": ~flag(pc.is_in(low, value_set=pa.array(sorted(OPENERS), pa.large_string()))),
        "marked": flag(pc.match_substring_regex(words, r"[^\pL\pN_]$")),
        "after": flag(pc.match_substring_regex(words, r"[.!?][^\pL\pN_$€£%°]*$")),
        "unit": (flag(pc.is_in(low, value_set=units)) | flag(pc.is_in(pc.utf8_lower(core), value_set=units))) & ~empty,
    }
    for k in np.flatnonzero(flag(pc.match_substring_regex(core, r"^[+-]?[$€£]?[0-9]"))):
        t = classify(words[k].as_py())
        if t.codes and t.codes[0][0] == int(NUM):
            first[k], second[k] = NUM, t.codes[1][0] if len(t.codes) > 1 else 0
            found["capital"][k] = found["unit"][k] = False
    return found | {"first": first, "second": second}


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, dict[str, np.ndarray]]:
    """Bounds of the texts, the numbers of their tokens, the distinct tokens and what they are."""
    # A line's end ends a sentence too.
    lined = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " . ")
    lists = pc.utf8_split_whitespace(lined)
    coded = pc.dictionary_encode(lists.flatten())
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.asarray(lists.offsets, np.int64)
    return bounds - bounds[0], ids, coded.dictionary, _classified(coded.dictionary)


def templates(texts: pa.Array, form: int = PLAIN) -> Templates:
    return formed(*read(texts), form)


def formed(bounds: np.ndarray, ids: np.ndarray, words: pa.Array, seen: dict[str, np.ndarray], form: int) -> Templates:
    first, second, empty, capital, after, unit = (seen[k] for k in ("first", "second", "empty", "capital", "after", "unit"))
    n = len(ids)
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1][bounds[:-1] < n]] = True
    opens = begins[:n].copy()
    opens[1:] |= after[ids[:-1]]
    # A token without a word passes on that a sentence begins.
    solid = np.flatnonzero(~empty[ids])
    group = np.concatenate([[0], np.cumsum(opens)])
    previous = np.concatenate([[-1], solid[:-1]])
    open_solid = group[solid + 1] > group[previous + 1]
    if form == VALUES:
        return Templates(seen["value"][ids[solid]], np.searchsorted(solid, bounds), solid, words, ids, np.zeros(len(solid), np.int64))
    code = first[ids[solid]].copy()
    is_number = code == NUM
    before_number = np.concatenate([[False], is_number[:-1]]) & ~begins_between(begins, previous, solid)
    code[unit[ids[solid]] & before_number] = UNIT
    name = capital[ids[solid]] & (~open_solid | (seen["other"][ids[solid]] & (form == NAMED))) & (code != UNIT)
    code[name] = NAME
    two = second[ids[solid]] != 0
    times = 1 + two.astype(np.int64)
    codes = np.repeat(code, times)
    part = np.zeros(len(codes), np.int64)
    at_second = np.cumsum(times)[two] - 1
    codes[at_second] = second[ids[solid]][two]
    part[at_second] = 1
    token = np.repeat(solid, times)
    # Names side by side are one name, but not over the end of a sentence, nor a word that opens one with what a mark parts from it.
    opened = np.repeat(open_solid, times)
    apart = opened[1:] | opened[:-1] & np.repeat(seen["marked"][ids[solid]], times)[:-1]
    text_of = np.searchsorted(bounds, token, side="right")
    merged = np.zeros(len(codes), bool)
    merged[1:] = (codes[1:] == NAME) & (codes[:-1] == NAME) & (text_of[1:] == text_of[:-1]) & ~apart
    codes, token, part, text_of = codes[~merged], token[~merged], part[~merged], text_of[~merged]
    starts = np.searchsorted(token, bounds)
    return Templates(codes, starts, token, words, ids, part)


def begins_between(begins: np.ndarray, previous: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Whether a text begins after the one token and up to the other."""
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[solid + 1] > total[previous + 1]


def windows(t: Templates, size: int, form: int = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first code, hash) of the windows of so many codes inside
    one text each, of templates only those with enough plain words."""
    n = len(t.codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size + (1 << 32 if form == VALUES else 0)))
    for k in range(size):
        h = h * np.uint64(_BASE) + t.codes[k : k + n]
    h ^= h >> np.uint64(29)
    plain = np.concatenate([[0], np.cumsum(~np.isin(t.codes, SLOTS))])
    text = np.searchsorted(t.starts, np.arange(n), side="right")
    whole = t.starts[np.minimum(text, len(t.starts) - 1)] >= np.arange(n) + size
    at = np.flatnonzero(whole & ((form == VALUES) | (2 * (plain[size:] - plain[:n]) >= size)))
    return at, h[at]


def _slots(t: Templates, at: int, size: int) -> list[str]:
    return [t.value(i) for i in np.flatnonzero(np.isin(t.codes[at : at + size], SLOTS)) + at]


def forms(texts: pa.Array, values: bool) -> Iterator[tuple[int, Templates, np.ndarray]]:
    """(form, templates, which texts have it): the second form only of texts
    in which it differs from the first, the third if it is asked for."""
    seen = read(texts)
    plain, named = formed(*seen, PLAIN), formed(*seen, NAMED)
    yield PLAIN, plain, np.ones(len(texts), bool)
    names = lambda t: np.diff(np.concatenate([[0], np.cumsum(t.codes == NAME)])[t.starts])
    # More names, or the same number of longer ones.
    other = (names(plain) != names(named)) | (np.diff(plain.starts) != np.diff(named.starts))
    if other.any():
        yield NAMED, named, other
    if values:
        yield VALUES, formed(*seen, VALUES), np.ones(len(texts), bool)


def _emit(t: Templates, row: np.ndarray, ids: list, keys: list, form: int, at: np.ndarray, h: np.ndarray, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[r] for r in row], pa.int64()),
            pa.array([keys[r] for r in row], pa.int64()),
            pa.array(np.full(len(at), form, np.int32)),
            pa.array(at - t.starts[row]),
            pa.array(np.full(len(at), size, np.int32)),
            pa.array(h.view(np.int64)),
            pa.array([_slots(t, a, size) for a in at.tolist()], pa.list_(pa.string())),
        ],
        ["id", "row", "form", "pos", "size", "hash", "slots"],
    )


_SCHEMA = "id long, row long, form int, pos long, size int, hash long, slots array<string>"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, text -> all windows; an item with fewer codes than a window is
    one window as a whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                ids = b.column("id").to_pylist()
                bare = np.ones(len(ids), bool)  # no window in the first form
                for form, t, has in forms(b.column("text"), True):
                    lengths = np.diff(t.starts)
                    has = bare if form == VALUES else has
                    for size in {WINDOW} | {int(n) for n in lengths if (1 if form == VALUES else SHORTEST) <= n < WINDOW}:
                        at, h = windows(t, size, form)
                        row = np.searchsorted(t.starts, at, side="right") - 1
                        own = has[row] & (lengths[row] >= WINDOW if size == WINDOW else lengths[row] == size)
                        if form == PLAIN:
                            bare[row[own]] = False
                        yield _emit(t, row[own], ids, ids, form, at[own], h[own], size)

    return benchmark.select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(run, _SCHEMA)


def document_windows(docs: DataFrame, bitmap: bytes, sizes: dict[bool, list[int]]) -> DataFrame:
    """doc_id, text -> the windows whose hash the bitmap has; ``row`` is a hash
    of the text, for alignments hold inside one text. ``sizes`` are those of
    the items' windows by value (true) and by template."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        for batch in batches:
            for b in slices(batch):
                ids, keys = b.column("id").to_pylist(), b.column("row").to_pylist()
                for form, t, has in forms(b.column("text"), bool(sizes[True])):
                    for size in sizes[form == VALUES]:
                        at, h = windows(t, size, form)
                        hit = bits[h >> np.uint64(64 - BITS)]
                        at, h = at[hit], h[hit]
                        row = np.searchsorted(t.starts, at, side="right") - 1
                        own = has[row]
                        if size < SHORTEST:
                            own &= np.diff(t.starts)[row] == size
                        if own.any():
                            yield _emit(t, row[own], ids, keys, form, at[own], h[own], size)

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, _SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, n, coverage, same): the pairs of a text, under its
    id and hash, with an item that contaminates it."""
    items = written(benchmark_windows(benchmark), "template-items")
    asked_for = items.select((F.col("form") == VALUES).alias("v"), "size").distinct().collect()  # at most 2 * WINDOW rows
    sizes = {v: sorted(r.size for r in asked_for if r.v == v) for v in (False, True)}
    places = items.select(F.shiftrightunsigned("hash", 64 - BITS).alias("p")).distinct().toArrow()["p"].to_numpy()  # at most 2**22
    bits = np.zeros(1 << BITS, bool)
    bits[places.astype(np.int64)] = True
    asked = document_windows(docs, np.packbits(bits).tobytes(), sizes)
    # A window that an item has twice counts once, where it stands first.
    once = items.groupBy(F.col("id").alias("item_id"), F.col("form").alias("item_form"), "size", "hash").agg(F.min_by("slots", "pos").alias("item_slots"), F.min("pos").alias("item_pos"))
    places = once.groupBy("item_id", "item_form").agg(F.collect_list("item_pos").alias("places"))
    met = written(asked.join(once, ["hash", "size"]), "template-matches")
    mark = F.struct((F.col("pos") - F.col("item_pos")).alias("line"), F.col("item_pos").alias("pos"), F.col("item_slots").alias("was"), F.col("slots").alias("now"))
    pairs = met.groupBy("id", "row", "form", "item_id", "item_form").agg(F.max("size").alias("size"), F.collect_set(mark).alias("marks")).join(places, ["item_id", "item_form"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                one = batch.slice(r, 1).to_pylist()[0]
                if found := judge(one["marks"], one["size"], one["places"]):
                    rows.append((one["id"], one["row"], one["item_id"], *found))
            yield pa.RecordBatch.from_pylist([dict(zip(judged.names, x, strict=True)) for x in rows], judged)

    judged = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("n", pa.int64()), ("coverage", pa.float64()), ("same", pa.bool_())])
    return pairs.select("id", "row", "item_id", "size", "marks", "places").mapInArrow(run, "doc_id long, row long, item_id long, n long, coverage double, same boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, reparameterised), one row per
    document and item that contaminates it.

    Null and empty texts, on either side, match nothing; an item of fewer than
    ``SHORTEST`` words and numbers matches only texts that are nothing else; a
    text of any length is read whole; rows with one doc_id count as one
    document, those without an id too; an item that stands twice in the
    benchmark is matched under both ids, an id given twice counts as the longer
    item; other columns are ignored.
    """
    best = F.max(F.struct("n", "coverage", "same")).alias("best")
    good = matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return good.select("doc_id", "item_id", F.col("best.n").alias("n_windows"), F.col("best.coverage").alias("coverage"), (~F.col("best.same")).alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose own text an item contaminates, with or
    without an id; unlike texts under one id are told apart by their hash."""
    row, gone_id, gone_row = fresh(docs, "row", "gone_id", "gone_row")
    gone = written(matches(docs, benchmark).select(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)).distinct(), "template-contaminated")
    hashed = docs.withColumn(row, F.xxhash64("text"))
    kept = hashed.join(gone, (F.col(row) == F.col(gone_row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def bridged(at: dict[int, list[int]], size: int, places: list[int]) -> set[int]:
    """The places of the item's windows that only an edit between two
    alignments of a chain broke. ``at``: the sorted places on each alignment."""
    found: set[int] = set()
    for a in at:
        for b in range(a - DRIFT, a + DRIFT + 1):
            if b == a or b not in at:
                continue
            for p in at[a]:
                k = bisect_right(at[b], p)
                if k < len(at[b]) and (q := at[b][k]) - p <= size + DRIFT and 0 < q + b - p - a <= size + DRIFT:
                    found.update(places[bisect_right(places, p) : bisect_right(places, q - 1)])
    return found


def kept(item: str, document: str) -> bool:
    """Whether a value is the item's, also if a capitalised neighbour of the
    passage has been merged with its first or last name."""
    return item == document or document.endswith(f" {item}") or document.startswith(f"{item} ")


def judge(marks: list[dict], size: int, places: list[int]) -> tuple[int, float, bool] | None:
    """(windows, coverage, whether all values are the item's) of the alignment
    or chain with the most windows, if it is enough. ``marks`` are the windows of a
    text that an item has too, ``places`` those of all windows of the item."""
    at: dict[int, set[int]] = {}
    values: dict[int, dict[str, str]] = {}
    broken = set()
    for m in marks:
        at.setdefault(m["line"], set()).add(m["pos"])
        own = values.setdefault(m["line"], {})
        # Equal values of the item must stand for equal values of the document.
        if any(own.setdefault(i, d) != d for i, d in zip(m["was"], m["now"], strict=True)):
            broken.add(m["line"])
    lines = sorted(at.keys() - broken)
    chains: list[list[int]] = []
    for k, line in enumerate(lines):
        if k and line - lines[k - 1] <= DRIFT:
            chains[-1].append(line)
        else:
            chains.append([line])
    places = sorted(places)
    found = []
    for chain in [[x] for x in lines] + [sorted(c, key=lambda x: (-len(at[x]), x)) for c in chains if len(c) > 1]:
        seen: dict[str, str] = {}
        held = {}
        for line in chain:
            if all(seen.get(i, d) == d for i, d in values[line].items()):
                seen.update(values[line])
                held[line] = sorted(at[line])
        whole = {p for x in held.values() for p in x}
        cover = len(whole | bridged(held, size, places))
        if cover >= COVERAGE * len(places) or cover >= RUN:
            found.append((len(whole), cover / len(places), all(kept(i, d) for i, d in seen.items())))
    return max(found, default=None)


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_ids, n_items, n_windows, reparameterised), one row per
    contaminated document; clean documents have none."""
    pairs = contaminated(docs, benchmark)
    return pairs.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.countDistinct("item_id").alias("n_items"), F.max("n_windows").alias("n_windows"), F.min("reparameterised").alias("reparameterised")
    )
