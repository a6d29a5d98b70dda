"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.workers import kept, small_batches, tidy

UNKNOWN = "und"
#: The bounded sample that each language's automaton is built from: so many whole labelled texts of so many bytes at most, so many bytes in all.
SAMPLE_TEXTS, TEXT_BYTES, SAMPLE_BYTES = 64, 1024, 32_768
#: Bits a byte, beside three whole phrases, up to which a text counts as written in the language that parses it best.
#: (Texts of the check tables need at most 5 in their own language, up to 6.2 a short one that holds a key; Finnish, Polish and random letters take 6.5 to 10 there.)
KNOWN_BITS = 5.75
#: Bytes of a sample at least for that: of less, a text in the language is mostly new.
LEAST_SAMPLE = 8_192
#: Bytes of the parts of a text that are parsed side by side; phrases go on from one to the next.
STRETCH = 512
#: Parts that are followed one by one, rather than side by side.
FEW = 48
#: Parts parsed at once.
LANES = 8192
#: Letters of ASCII and all bytes of other characters are kept; the rest parts words.
_KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8).tobytes()


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_KEPT)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class SuffixAutomaton:
    """All substrings of ``text`` as a table: state and symbol to next state, or -1.

    Symbols are the distinct bytes of the text in order, and one more for all others.
    """

    def __init__(self, text: bytes):
        nexts, link, length, last = [{}], [-1], [0], 0
        for symbol in text:
            made, at = len(nexts), last
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            while at != -1 and symbol not in nexts[at]:
                nexts[at][symbol] = made
                at = link[at]
            if at != -1:
                to = nexts[at][symbol]
                if length[to] == length[at] + 1:
                    link[made] = to
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at != -1 and nexts[at].get(symbol) == to:
                        nexts[at][symbol] = copy
                        at = link[at]
                    link[to] = link[made] = copy
            last = made
        symbols = sorted(set(text))
        self.symbol_of = np.full(256, len(symbols), np.uint8)
        self.symbol_of[symbols] = np.arange(len(symbols))
        self.table = np.full((len(nexts), len(symbols) + 1), -1, np.int32)
        for state, moves in enumerate(nexts):
            for symbol, to in moves.items():
                self.table[state, self.symbol_of[symbol]] = to


class CrossParser:
    """Counts the phrases that a text needs, each the longest match in the automaton's text from where the last ended."""

    def __init__(self, text: bytes):
        automaton = SuffixAutomaton(text)  # let go once the moves are made
        states, width = automaton.table.shape
        self.symbol_of, self.pad = automaton.symbol_of, width
        root = automaton.table[0]
        move = np.empty((states, width + 1), np.int32)
        ends = automaton.table < 0
        # A symbol that does not continue the match ends the phrase and begins the next;
        # one that occurs nowhere is a phrase by itself. The low bit counts phrases that ended.
        fresh = np.where(root < 0, 0, root)
        move[:, :width] = np.where(ends, fresh[None, :], automaton.table) * ((width + 1) * 2) + ends
        move[0, :width] = np.where(root < 0, 1, root * ((width + 1) * 2))
        move[:, width] = 1  # padding ends what is open
        move[0, width] = 0
        extra = (root < 0).nonzero()[0]
        # From inside a match, an unknown symbol ends it and is a phrase too: two, kept apart.
        self.double = np.zeros(width + 1, np.uint8)
        self.double[extra] = 1
        self.move = move.ravel()
        self.scale = (width + 1) * 2

    def count(self, parts: np.ndarray, inside: np.ndarray, goes_on: np.ndarray, entry: int = 0) -> tuple[np.ndarray, int]:
        """Phrases that end in each column of ``parts`` (bytes; False in ``inside`` where past the end), and the last state.

        A column in ``goes_on`` continues the text of the column before it, the
        first one from the state ``entry``; one more flag tells whether the last goes on. All
        columns are first parsed as if a phrase began with each; then those that
        are entered within a phrase are parsed again from there, until they fall
        in with the first parse, which they mostly do after a few bytes. The few
        that don't are followed one by one, into the next columns where need be,
        so the counts are those of one parse from the text's first byte.
        """
        rows, columns = parts.shape
        symbols = np.where(inside, self.symbol_of[parts], np.uint8(self.pad))
        path = np.empty((rows, columns), np.int32)
        phrases = np.zeros(columns, np.int32)
        state = np.zeros(columns, np.int32)
        for k in range(rows):
            state, ended = self._step(state, symbols[k])
            path[k] = state
            phrases += ended
        enter = np.where(goes_on[:-1], np.r_[entry, path[-1, :-1]].astype(np.int32), 0)
        at, k = np.flatnonzero(enter), 0
        new, old = enter[at], np.zeros(len(at), np.int32)
        while k < rows and len(at) > FEW:
            row = symbols[k, at]
            new, ended = self._step(new, row)
            old, before = self._step(old, row)
            phrases[at] += ended - before
            path[k, at] = new
            k += 1
            apart = np.flatnonzero(new != old)
            if len(apart) < len(at):
                at, new, old = at[apart], new[apart], old[apart]
        for column, a, b in zip(at.tolist(), new.tolist(), old.tolist()):
            self._follow(symbols, path, phrases, column, k, a, b)
        for column in (np.flatnonzero(goes_on[1:-1] & (path[-1, :-1] != enter[1:])) + 1).tolist():
            while column < columns and goes_on[column] and path[-1, column - 1] != enter[column]:
                self._follow(symbols, path, phrases, column, 0, int(path[-1, column - 1]), int(enter[column]))
                enter[column] = path[-1, column - 1]
                column += 1
        return phrases + (~goes_on[1:] & (path[-1] != 0)), int(path[-1, -1])

    def _follow(self, symbols: np.ndarray, path: np.ndarray, phrases: np.ndarray, column: int, begin: int, new: int, old: int) -> None:
        """Parse a column from ``new`` where it was parsed from ``old``, until both fall together."""
        move, double = memoryview(self.move), self.double.tolist()
        more, went = 0, []
        for symbol in symbols[begin:, column].tolist():
            a, b = move[(new >> 1) + symbol], move[(old >> 1) + symbol]
            more += (a & 1) - (b & 1) + double[symbol] * ((new != 0) - (old != 0))
            new, old = a & ~1, b & ~1
            went.append(new)
            if new == old:
                break
        path[begin : begin + len(went), column] = went
        phrases[column] += more

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol each, and the phrases that ended with it."""
        moved = self.move[(state >> 1) + row]
        ended = moved & 1
        double = self.double[row]
        return moved - ended, ended + (double & (state != 0)) if double.any() else ended


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into columns of STRETCH bytes: bytes, whether inside the text, and the text of each column."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    columns = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), columns)
    out = np.zeros(int(columns.sum()) * STRETCH, np.uint8)
    inside = np.zeros(len(out), bool)
    at = 0
    for text, n in zip(texts, columns):
        out[at : at + len(text)] = np.frombuffer(text, np.uint8)
        inside[at : at + len(text)] = True
        at += int(n) * STRETCH
    return np.ascontiguousarray(out.reshape(-1, STRETCH).T), np.ascontiguousarray(inside.reshape(-1, STRETCH).T), owner


class LanguageModel:
    """One parser per language, built once per worker."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.parsers = [CrossParser(samples[n]) for n in self.names]
        self.weight = [np.log2(max(2, len(samples[n]))) for n in self.names]

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits a byte for each text (row) and language (column): phrases times the bits that name a place in the sample."""
        total = np.zeros((len(texts), len(self.names)))
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text) + STRETCH
            if size > LANES * STRETCH or i == len(texts) - 1:
                columns, inside, owner = stretches([texts[j] for j in group])
                goes_on = np.r_[False, owner[1:] == owner[:-1], False]
                for k, parser in enumerate(self.parsers):
                    state = 0
                    for begin in range(0, len(owner), LANES):
                        part = slice(begin, begin + LANES)
                        phrases, state = parser.count(columns[:, part], inside[:, part], goes_on[begin : begin + LANES + 1], state)
                        total[group, k] += np.bincount(owner[part], phrases, len(group)) * self.weight[k]
                group, size = [], 0
        return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def model(samples: dict[str, bytes]) -> LanguageModel:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).digest()
    return kept(key, lambda: LanguageModel(samples))


def language_samples(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_texts: int = SAMPLE_TEXTS, text_bytes: int = TEXT_BYTES, sample_bytes: int = SAMPLE_BYTES,
) -> dict[str, bytes]:
    """A bounded sample of normalised text per language, of whole distinct texts.

    Equal texts count once. Texts of at most ``text_bytes`` come first, in the order
    of their hashes, then longer ones by size, so many as ``sample_texts`` and
    ``sample_bytes`` hold. Of a language whose shortest text is longer than that,
    ``sample_bytes`` of this text are learnt. The driver gathers no more per language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("size"))
    order = [F.greatest("size", F.lit(text_bytes)), "h"]  # short texts are all alike
    best = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy(*order), Window.partitionBy("lang").orderBy(*order)
    # Ranked within 64 parts of a language first, so that few rows meet in one task.
    chosen = rows.groupBy("lang", "h", "size").agg(F.min("id").alias("id")).withColumn("n", F.row_number().over(best[0])).where(F.col("n") <= sample_texts)
    upto = F.sum(F.col("size") + 1).over(best[1].rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = chosen.withColumn("n", F.row_number().over(best[1])).withColumn("upto", upto)
    chosen = chosen.where((F.col("n") <= sample_texts) & ((F.col("n") == 1) | (F.col("upto") <= sample_bytes + 1)))
    texts = rows.join(F.broadcast(chosen.select("lang", "h", "id")), ["lang", "h", "id"]).select("lang", "h", F.left("text", F.lit(sample_bytes)).alias("text"))
    found: dict[str, list[str]] = {}
    for r in texts.dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():
        found.setdefault(r.lang, []).append(r.text)
    samples = {lang: b" ".join(map(normalise, own))[:sample_bytes] for lang, own in found.items()}
    return {lang: s for lang, s in samples.items() if s.strip()}


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Adds ``lang_pred`` (the language that parses the text in the fewest bits; ties
    to the name that sorts first), ``score`` (the lead over the second, 0 to 1; 1
    if only one is known) and ``bits`` (bits a byte in that language). A text that
    is null or has no letter is ``und`` with score 0, as is every text if no
    language is known. Repeated rows stay; columns named like the new ones are
    replaced; other columns are kept.
    """
    docs = docs.drop("lang_pred", "score", "bits")
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, score, bits in _predicted(batches, samples, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=schema.names)

    return small_batches(docs).mapInArrow(tidy(run), schema)


def in_known_language(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", known_bits: float = KNOWN_BITS) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages of ``samples``, all columns as they are.

    Those go that ``identify`` gives no language, and those that even the
    language that parses them best needs more than ``known_bits`` a byte for,
    with three phrases allowed to any text, however short: text in none of the
    languages falls into phrases of two or three bytes. A language known from
    fewer than ``LEAST_SAMPLE`` bytes rejects nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {n: np.log2(max(2, len(s))) for n, s in samples.items()}
        for batch, lang, _, bits in _predicted(batches, samples, text_col):
            keep = []
            for k, name in enumerate(lang):
                if name != UNKNOWN and len(samples[name]) >= LEAST_SAMPLE:
                    size = len(normalise(batch[text_col][k].as_py()))
                    keep.append(bits[k] * size <= known_bits * size + 3 * weight[name])
                else:
                    keep.append(name != UNKNOWN)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def _predicted(batches: Iterator[pa.RecordBatch], samples: dict[str, bytes], text_col: str) -> Iterator[tuple]:
    """Batches with the language, score and bits of each text."""
    known = model(samples) if samples else None
    for whole in batches:
        for begin in range(0, whole.num_rows, 1000):
            batch = whole.slice(begin, 1000)
            texts = batch[text_col].to_pylist()
            there = [i for i, t in enumerate(texts) if known and t and has_letter(t)]
            lang, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if there:
                cost = known.costs([normalise(texts[i]) for i in there])
                best = cost.argmin(1)
                for i, row, k in zip(there, cost, best):
                    lang[i], bits[i] = known.names[k], float(row[k])
                    score[i] = 1.0 if len(row) == 1 else float(1 - row[k] / np.partition(row, 1)[1])
            yield batch, lang, score, bits


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id, as text, leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
