"""Symbol graphs: definitions, callers and callees, search by part of a name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialise import durable

_PARSER = re._parser
#: Triggers without a literal that go out to the tasks at a time, and patterns that a task keeps compiled.
TRIGGER_BLOCK = 20_000
#: Characters of a key at most; words of 64 bits in the table of keys at most; characters that are searched at once; places found that are sent on at once.
KEY_CHARS, MOST_WORDS, CHARS_AT_ONCE, PLACES_AT_ONCE = 32, 1 << 21, 1 << 17, 1 << 20
#: Lengths of the beginnings of keys that are in the table as well, so that longer keys are looked up in few places.
BEGINNINGS = (6, 8, 11, 14, 18, 24)
CALLS = ("calls", "references")


def definitions(occurrences: DataFrame, symbols: DataFrame, most: int = 500) -> DataFrame:
    return occurrences.where("role = 'definition'").join(symbols, "symbol").orderBy("path", "symbol").limit(most)


def callers(edges: DataFrame, symbol_col: str = "dst") -> DataFrame:
    """symbol, callers, n: for every symbol that is called. edges: src, dst, kind."""
    other = "src" if symbol_col == "dst" else "dst"
    used = edges.where(F.col("kind").isin(list(CALLS))).select(F.col(symbol_col).alias("symbol"), F.col(other).alias("other")).distinct()
    return used.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first_other"))


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """src, dst, hops: pairs that calls connect within a number of hops, with the least number."""
    one = edges.where(F.col("kind").isin(list(CALLS))).select("src", "dst").distinct()
    found = one.withColumn("hops", F.lit(1))
    far = one
    for h in range(2, hops + 1):
        far = far.alias("a").join(one.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        found = found.unionByName(far.withColumn("hops", F.lit(h)))
    return found.groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def find_symbols(symbols: DataFrame, part: str, most: int = 20) -> DataFrame:
    """Symbols whose name or display name holds a part, without regard to ASCII case."""
    low = part.lower()
    return symbols.where(F.lower("symbol").contains(low) | F.lower("display_name").contains(low)).orderBy("symbol").limit(most)


def by_prefix(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """The row with the id, or else the only one whose id starts with it; none if several do."""
    exact = rows.where(F.col(id_col) == prefix)
    near = rows.where(F.col(id_col).startswith(prefix) & (F.col(id_col) != prefix)).limit(2)
    one = near.agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return exact.unionByName(near.crossJoin(one).drop("n").crossJoin(exact.agg(F.count(F.lit(1)).alias("n")).where("n = 0")).drop("n"))  # two rows at most


def match_triggers(skills: DataFrame, utterances: DataFrame, block: int = TRIGGER_BLOCK) -> DataFrame:
    """skill_id, utterance_id: triggers that fit as a pattern, without regard to case, or as plain text where they are no pattern.

    skills: skill_id, trigger; utterances: utterance_id, text. Each trigger has literals that any match must hold, where it has any at
    all; they are read once, and the longest, KEY_CHARS of it at most, is the trigger's key. The tasks find the keys in the utterances by
    a table of bits, whose chance hits find no trigger when keys and triggers are joined; so the work grows with the utterances and with what is found in them, not
    with the product of both tables. Where the key says all that the trigger says, nothing else is tried; other triggers are tried on the texts that hold
    their keys. Triggers without a literal are tried everywhere: they go out in blocks of ``block``, one scan of the utterances each.
    """
    spark = skills.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = skills.where("trigger IS NOT NULL").select("skill_id", "trigger").distinct()
    read = rows.select("skill_id", "trigger", F.lit(True).alias("pattern"), F.array(F.lit("")).alias("literals"), F.lit(None).cast("string").alias("key"), F.lit(True).alias("whole"))
    # Reading triggers and searching texts cost far more than a row's size tells: as many tasks as a shuffle has.
    rows = durable(rows.repartition(parts).mapInArrow(_read_triggers, read.schema))
    texts = utterances.where("text IS NOT NULL").select("utterance_id", "text").repartition(parts)
    schema = rows.select("skill_id").crossJoin(utterances.select("utterance_id").limit(0)).schema
    n_all, n_keys, lengths = rows.agg(F.count(F.lit(1)), F.count("key"), F.collect_set(F.length("key"))).first()
    out = [spark.createDataFrame([], schema)]
    if n_keys:
        held = texts.mapInArrow(_find_keys(_key_table(rows, n_keys), sorted(lengths)), texts.select(F.lit("").alias("key"), F.array("utterance_id").alias("ids")).schema)
        met = lambda some: rows.where(some).join(held, "key").withColumn("utterance_id", F.explode("ids"))
        out.append(met("whole").select("skill_id", "utterance_id"))
        near = met("NOT whole").select("skill_id", "trigger", "pattern", "literals", "utterance_id").distinct().alias("near")
        near = near.join(texts.alias("t"), F.col("near.utterance_id").eqNullSafe(F.col("t.utterance_id"))).select("skill_id", "t.utterance_id", "trigger", "pattern", "literals", "text")
        out.append(near.mapInArrow(_try_near, schema))
    n = -(-(n_all - n_keys) // block)
    for b in range(n):
        part = rows.where("key IS NULL").where(F.pmod(F.xxhash64("trigger"), F.lit(n)) == b).select("skill_id", "trigger").toArrow()
        out.append(texts.mapInArrow(_try_everywhere(spark.sparkContext.broadcast((part.column(0), part.column(1).to_pylist()))), schema))
    return reduce(DataFrame.unionByName, out)


#: Letters outside ASCII that match an ASCII letter without regard to case.
_ALIKE = {"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"}


def _runs(pattern: str) -> tuple[list[str], bool]:
    """The runs of required_literals, and whether the pattern says no more than that its one run is held."""
    parsed = _PARSER.parse(pattern, re.IGNORECASE)
    runs, whole = [""], parsed.state.flags == re.IGNORECASE | re.UNICODE
    for op, what in parsed:
        if op is _PARSER.LITERAL and what < 128:
            runs[-1] += chr(what).lower()
            whole = whole and not chr(what).isspace()
        elif (op, what) == _SPACE or (op is _PARSER.MAX_REPEAT and what[0] > 0 and list(what[2]) == [_SPACE]):
            whole = whole and op is _PARSER.MAX_REPEAT and tuple(what[:2]) == (1, _PARSER.MAXREPEAT) and not runs[-1].endswith(" ")
            runs[-1] += " "
        else:
            runs.append("")
    return [one_space(run) for run in runs if run], whole and len(runs) == 1 and runs != [""]


def required_literals(pattern: str) -> list[str]:
    """The runs of ASCII characters, in lower case, that every match of a pattern holds, in order; white space of any length and kind is one space in them."""
    return _runs(pattern)[0]


#: A white-space class, as the parser reads it.
_SPACE = _PARSER.parse(r"\s")[0]


def one_space(text: str) -> str:
    return " ".join(f"x{text}x".split())[1:-1]


def _levelled(text: str) -> str:
    """A text as literals are looked up in it."""
    if not text.isascii():
        for letter, like in _ALIKE.items():
            text = text.replace(letter, like)
    return one_space(text.lower())


def required_literal(pattern: str) -> str:
    """The longest of the required literals; empty if there is none."""
    return max(required_literals(pattern), key=len, default="")


def _read_triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """skill_id, trigger -> skill_id, trigger, pattern (whether it is one), literals, key (null without a literal), whole (whether a text that holds the key fits)."""
    for batch in batches:
        pattern, literals, key, whole = [], [], [], []
        for trigger in batch.column(1).to_pylist():
            try:
                held, all_said = _runs(trigger)
                if "(?<" in trigger:  # what the parser alone doesn't refuse
                    re.compile(trigger, re.IGNORECASE)
                pattern.append(True)
            except re.error:  # it has a sign of ASCII at least
                held, all_said = [one_space(run) for run in re.findall(r"[\x00-\x7f]+", trigger.lower())], False
                pattern.append(False)
            longest = max(held, key=len, default=None)
            literals.append(held)
            key.append(longest and longest[:KEY_CHARS])
            whole.append(all_said and len(longest) <= KEY_CHARS)
        columns = [*batch.columns, pa.array(pattern, pa.bool_()), pa.array(literals, pa.list_(pa.string())), pa.array(key, pa.string()), pa.array(whole, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["skill_id", "trigger", "pattern", "literals", "key", "whole"])


#: An odd base of hashes of 64 bits, what undoes it, and a factor that spreads them; four bits of a word, or fewer where some are equal, for each value of 16 bits.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_UNDO = pow(_BASE, -1, 1 << 64)
_FOUR_BITS = np.bitwise_or.reduce([np.uint64(1) << (np.arange(1 << 16, dtype=np.uint64) * _SPREAD >> np.uint64(k) & np.uint64(63)) for k in (24, 34, 44, 54)])


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


class _Hashes:
    """Hashes of the runs of characters in a text: the sum of each character times a power of its place, from the run's start."""

    def __init__(self, text: str):
        n = len(text)
        self.sums, self.undo = np.zeros(n + 1, np.uint64), _powers(_UNDO, n)
        np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) * _powers(_BASE, n)[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.undo[start]
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        return x ^ x >> np.uint64(32)


def _key_table(rows: DataFrame, n_keys: int):
    """A broadcast table of the keys: four bits in one of MOST_WORDS words at most for each of them. A full table costs speed only."""
    width = min(max(n_keys.bit_length(), 10), (MOST_WORDS - 1).bit_length())
    words = rows.where("key IS NOT NULL").select("key").distinct().mapInArrow(_key_words(width), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << width, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(table)


def _key_words(width: int):
    """key -> word, bits: of each key and, by other hashes, of its beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            n = np.array([len(k) for k in keys], np.int64)
            start, hashes = np.cumsum(n) - n, _Hashes("".join(keys))
            x = np.concatenate([hashes.runs(start, start + n), *(~hashes.runs(start[n >= k], start[n >= k] + k) for k in BEGINNINGS)])
            yield pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(64 - width)).astype(np.int64)), pa.array(_FOUR_BITS[x & np.uint64(0xFFFF)].view(np.int64))], names=["word", "bits"])

    return run


def _find_keys(shared, lengths: list[int]):
    """utterance_id, text -> key, ids: for what the table takes for keys, the utterances that hold it, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.uint64(64 - (len(table) - 1).bit_length())

        def known(x: np.ndarray) -> np.ndarray:
            bits = _FOUR_BITS[x & np.uint64(0xFFFF)]
            return np.flatnonzero(table[x >> shift] & bits == bits)

        for batch in batches:
            keys, of, last = [], [np.empty(0, np.int64)], None
            for rows, starts, text in _joined(batch.column(1)):
                if len(keys) >= PLACES_AT_ONCE and rows[0] != last:
                    yield _listed(keys, np.concatenate(of), batch.column(0))
                    keys, of = [], of[:1]
                last = rows[-1]
                hashes, places = _Hashes(text), None  # all of them
                for n in sorted({*lengths, *(k for k in BEGINNINGS if k <= lengths[-1])}):
                    if places is None:
                        x = hashes.runs(slice(None, max(len(text) + 1 - n, 0)), slice(n, None))
                    else:
                        places = places[: np.searchsorted(places, len(text) - n, "right")]
                        x = hashes.runs(places, places + n)
                    if n in BEGINNINGS:  # longer keys can be only where one begins
                        at = known(~x)
                        places, x = at if places is None else places[at], x[at]
                    at = known(x)
                    at = at if places is None else places[at]
                    keys += [text[i : i + n] for i in at.tolist()]
                    of.append(rows[np.searchsorted(starts, at, "right") - 1])
            yield _listed(keys, np.concatenate(of), batch.column(0))

    return run


def _joined(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Rows, where each starts, and their texts as one, CHARS_AT_ONCE at a time, with a sign between them that no key holds.

    Longer texts come in parts that overlap by what a key may hold, each with its row.
    """
    rows, starts, texts, n = [], [], [], 0
    for row, text in enumerate(column.to_pylist()):
        text = _levelled(text)
        for at in range(0, max(len(text) - KEY_CHARS + 1, 1), CHARS_AT_ONCE):
            part = text[at : at + CHARS_AT_ONCE + KEY_CHARS - 1]
            rows.append(row)
            starts.append(n)
            texts.append(part)
            n += len(part) + 1
            if n >= CHARS_AT_ONCE:
                yield np.array(rows), np.array(starts), "\uffff".join(texts)
                rows, starts, texts, n = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), "\uffff".join(texts)


def _listed(keys: list[str], rows: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """key, ids: the ids of the rows of each key, each row once."""
    coded = pa.array(keys, pa.string()).dictionary_encode()
    pairs = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | rows)
    ends = np.concatenate(([0], np.cumsum(np.bincount(pairs >> 32, minlength=len(coded.dictionary)))))
    return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(pairs & 0xFFFFFFFF)))], names=["key", "ids"])


def _try_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """skill_id, utterance_id, trigger, pattern, literals, text -> skill_id, utterance_id, of those that fit."""
    compiled = lru_cache(TRIGGER_BLOCK)(lambda trigger: re.compile(trigger, re.IGNORECASE))
    last = levelled = None
    for batch in batches:
        hit = []
        for i, (trigger, pattern, literals, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
            if text != last:
                last, levelled = text, _levelled(text)
            if all(x in levelled for x in literals) and (compiled(trigger).search(text) if pattern else trigger.lower() in text.lower()):
                hit.append(i)
        yield batch.select([0, 1]).take(pa.array(hit, pa.int64()))


def _try_everywhere(shared):
    """Triggers without a literal; each is a pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skills, triggers = shared.value
        compiled = [re.compile(trigger, re.IGNORECASE) for trigger in triggers]
        for batch in batches:
            hit, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = [k for k, trigger in enumerate(compiled) if trigger.search(text)]
                hit += found
                of += [i] * len(found)
            yield pa.RecordBatch.from_arrays([skills.take(pa.array(hit, pa.int64())).combine_chunks(), batch.column(0).take(pa.array(of, pa.int64()))], names=["skill_id", "utterance_id"])

    return run
