"""Language-model scores: logistic mixing of hashed-context bit predictors, learnt from the corpus.

A text is a sequence of words and an end. The few thousand most frequent words are symbols of a binary code (words.py): their bits
are predicted from contexts that cross words - the last word, the last two very frequent words - and mixed by weights
that a gate selects, then refined. Of a rare word the class (its first two bytes) is such a symbol; the rest is spelled, bit by
bit (spelling.py). Spelling looks at nothing outside the word, so each distinct rare word is spelled once in the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.mixer import coded
from lumora.llm.spelling import CLASS, HASHED, STEM, Speller, count_into, events_of, stretches
from lumora.llm.words import END as END_SYMBOL
from lumora.llm.words import RARE, Pairs, WordCode, WordModel
from lumora.session import discard, settle, small_batches

END = b"\n"
GROUP = 256  # texts that are looked at together
PIECE = 1 << 23  # bytes of texts that are split together
BLOCK = 1 << 16
FAN = 32  # tables that are summed together


def training_rows(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held, F.lit(True))


def crc_fold(doc_id: int, folds: int = 7) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE // max(PIECE, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words of each); A-Z lower-cased, cut at ASCII white space only, null texts empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0  # a text that begins or ends with white space has an empty part there
    before = np.append(0, np.cumsum(full))
    return flat.filter(pa.array(full)).cast(pa.binary()), np.diff(before[lists.offsets.to_numpy()])


def vocabulary(df: DataFrame, id_col: str, text_col: str, keep: int = 200_000) -> DataFrame:
    """(word, n): every word of all rows and its training occurrences, counted in tasks (keep words at a time) before they meet."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": found["word"], "n": found["n_sum"]}).combine_chunks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for piece in _pieces(batches):
            flat, lengths = split_words(piece.column("text"))
            coded = flat.dictionary_encode()
            learnt = np.repeat(piece.column("train").to_numpy(zero_copy_only=False), lengths)
            n = np.bincount(coded.indices.to_numpy()[learnt], minlength=len(coded.dictionary))
            parts.append(pa.table({"word": coded.dictionary, "n": n}))
            size += len(n)
            if size > 2 * keep:
                parts = [summed(parts)]
                size = len(parts[0])
                if size > keep:
                    yield from parts.pop().to_batches()
                    size = 0
        if parts:
            yield from summed(parts).to_batches()

    slim = df.select(F.col(f"`{text_col}`").alias("text"), training_rows(F.col(f"`{id_col}`")).alias("train"))
    return slim.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# tables of counts ---------------------------------------------------------------------------------------------------


def _blocks(tables: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """A task's tables in compressed blocks; empty ones are left out."""
    for k, table in enumerate(tables):
        for at in range(0, len(table), 2 * BLOCK):
            part = table[at : at + 2 * BLOCK]
            if part.any():
                yield pd.DataFrame({"k": [k], "at": [at], "data": [zlib.compress(part.astype("<u4").tobytes(), 1)]})


def _summed(blocks: DataFrame, tasks: int) -> DataFrame:
    """Blocks (k, at, task, data) of all tasks added up, at most FAN in one place at a time."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(zlib.decompress(b), "<u4") for b in frame["data"]], axis=0, dtype=np.uint64)
        data = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pd.DataFrame({"k": frame["k"].iloc[:1], "at": frame["at"].iloc[:1], "task": frame["task"].iloc[:1], "data": [data]})

    while tasks > 1:
        blocks = blocks.withColumn("task", F.expr(f"task div {FAN}"))
        blocks = blocks.groupBy("k", "at", "task").applyInPandas(add, "k int, at int, task long, data binary")
        tasks = -(-tasks // FAN)
    return blocks


def _gathered(rows: DataFrame, fill: Callable, sizes: list[int], tasks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coded zeros, coded ones) of tables that fill's tasks have counted. sizes bounds what comes to the driver, not the data."""
    parts = rows.withColumn("task", F.spark_partition_id().cast("long")).mapInPandas(fill, "k int, at int, task long, data binary")
    out = [(np.zeros(n, np.uint8), np.zeros(n, np.uint8)) for n in sizes]
    for r in _summed(parts, tasks).collect():
        both = coded(np.frombuffer(zlib.decompress(r["data"]), "<u4").astype(float)).reshape(-1, 2)
        at = r["at"] // 2
        out[r["k"]][0][at : at + len(both)], out[r["k"]][1][at : at + len(both)] = both[:, 0], both[:, 1]
    return out


def _with_task(frames: Iterator[pd.DataFrame], seen: list) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            seen[:] = [int(frame["task"].iloc[0])]
        yield frame


# rare words ---------------------------------------------------------------------------------------------------------


def _by_stem(vocab: DataFrame, parts: int | None = None) -> DataFrame:
    stem = F.substring("word", 1, STEM)
    dealt = vocab.repartition(parts, stem) if parts else vocab.repartition(stem)
    return dealt.sortWithinPartitions("word")


def fit_speller(vocab: DataFrame, table_bits: int, tasks: int) -> Speller:
    """Tables and mixing weights from all training words in vocab(word, n), each occurrence left out of its own counts."""
    seen = settle(_by_stem(vocab.where("n > 0"), tasks))

    def tally(frames):
        tables, task = [np.zeros(2 << table_bits, "f4") for _ in range(HASHED)], [0]
        for words, counts, stem in stretches(_with_task(frames, task)):
            count_into(tables, events_of(words, counts, stem), table_bits)
        for block in _blocks(tables):
            yield block.assign(task=task[0])

    dealt = seen.repartition(tasks, F.substring("word", 1, STEM)).sortWithinPartitions("word")
    found = _gathered(dealt, tally, [1 << table_bits] * HASHED, tasks)
    model = Speller(table_bits, np.stack([z for z, _ in found]), np.stack([o for _, o in found]))
    shared = vocab.sparkSession.sparkContext.broadcast(model)

    def learn(frames):
        own, total = shared.value, 0.0
        own.mixer = Speller(own.table_bits, own.zeros, own.ones).mixer
        own.mixer.begin()
        for words, counts, stem in stretches(frames):
            total += own.learn(events_of(words, counts, stem))
        if total:
            yield pd.DataFrame({"seen": [total], "state": [own.mixer.state()]})

    states = dealt.mapInPandas(learn, "seen double, state binary").collect()
    if states:
        model.mixer.restore([r["state"] for r in states], [r["seen"] for r in states])
    return model


def class_of(word: bytes) -> bytes:
    return (word + b" ")[:CLASS]


def spelled(vocab: DataFrame, model: Speller, classes: dict[bytes, int]) -> DataFrame:
    """(word, n, bits): log2 probability of every word of vocab, given its class if it has one; each scored once in the corpus."""
    shared = vocab.sparkSession.sparkContext.broadcast((model, frozenset(classes)))

    def score(frames):
        own, named = shared.value
        for words, counts, stem in stretches(frames):
            whole, rest = own.words(words, counts, stem)
            has = np.fromiter((class_of(w) in named for w in words), bool, len(words))
            yield pd.DataFrame({"word": words, "n": counts.astype("int64"), "bits": np.where(has, rest, whole)})

    return _by_stem(vocab).mapInPandas(score, "word binary, n long, bits double")


# words in context ---------------------------------------------------------------------------------------------------


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of runs of data, a value for each length."""
    ends = np.append(0, np.cumsum(lengths) * data.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all values, how many each value has) of what _binaries has made."""
    lengths = pc.binary_length(column).to_numpy() // kind.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64), lengths


def _ended(of_words: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Numbers of all words, with that of the end after those of each text."""
    out = np.full(len(of_words) + len(lengths), end, np.int64)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(lengths + 1) - 1] = False
    out[is_word] = of_words
    return out


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word in among; -1 if it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


class Symbols:
    """Numbers of known words; any other word is asked for by its class, which is RARE if it has none."""

    def __init__(self, known: dict[bytes, int], classes: dict[bytes, int]):
        self.known, self.classes = (pa.array(list(x), pa.binary()) for x in (known, classes))
        self.of_known, self.of_class = np.array([*known.values(), 0]), np.array([*classes.values(), RARE])

    def of(self, words: pa.Array) -> np.ndarray:
        at = _places(words, self.known)
        out, missing = self.of_known.take(at), np.flatnonzero(at < 0)
        out[missing] = self.by_class(words.take(pa.array(missing)))
        return out

    def by_class(self, words: pa.Array) -> np.ndarray:
        first = pc.binary_slice(pc.binary_join_element_wise(words, b" ", b""), 0, CLASS)
        return self.of_class.take(_places(first, self.classes))


def _kind(code: WordCode) -> np.dtype:
    return np.dtype("<u2" if code.symbols <= 1 << 16 else "<u4")


def fit_words(rows: DataFrame, code: WordCode, known: Symbols, tasks: int) -> WordModel:
    """fit_symbols of rows(text). known: symbols of END, the code's words and classes."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(known), _kind(code)

    def name(batches):
        for piece in _pieces(batches):
            words, lengths = split_words(piece.column("text"))
            symbols = _ended(shared.value.of(words), lengths, END_SYMBOL)
            yield pa.RecordBatch.from_arrays([_binaries(symbols.astype(kind), lengths + 1)], ["symbols"])

    named = settle(rows.mapInArrow(name, "symbols binary"))
    model = fit_symbols(named, code, tasks)
    discard(named)
    return model


def fit_symbols(named: DataFrame, code: WordCode, tasks: int) -> WordModel:
    """Tables from all words of named(symbols) in context; then mixing weights, learnt online along the texts.

    The weights learn from all texts too, each word left out of the counts that predict it.
    """
    spark, kind = named.sparkSession, _kind(code)
    shared, dealt = spark.sparkContext.broadcast(code), named.coalesce(tasks)

    def groups(frames):
        for frame in frames:
            for at in range(0, len(frame), GROUP):
                part = frame["symbols"].iloc[at : at + GROUP]
                yield np.frombuffer(b"".join(part), kind).astype(np.int64), [len(x) // kind.itemsize for x in part]

    def tally(frames):
        own, task = shared.value, [0]
        pairs = Pairs(own)
        for symbols, lengths in groups(_with_task(frames, task)):
            pairs.add(symbols, *own.contexts(symbols, lengths))
        for block in _blocks(pairs.tables()):
            yield block.assign(task=task[0])

    found = _gathered(dealt, tally, code.sizes, tasks)
    model = WordModel(code, [z.astype(np.uint16) << 8 | o for z, o in found])
    tables = spark.sparkContext.broadcast(model.tables)

    def learn(frames):
        given, total = shared.value, 0.0
        own = WordModel(given, tables.value)
        own.mixer.begin()
        for symbols, lengths in groups(frames):
            total += own.learn(symbols, own.code.contexts(symbols, lengths))
        if total:
            yield pd.DataFrame({"seen": [total], "state": [own.mixer.state()]})

    states = dealt.mapInPandas(learn, "seen double, state binary").collect()
    if states:
        model.mixer.restore([r["state"] for r in states], [r["seen"] for r in states])
    return model


def score_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    coded_words: int = 3840,
    classes: int = 254,
    least: int = 3,
    table_bits: int = 22,
    spell_bits: int = 20,
    hot: int = 100_000,
) -> DataFrame:
    """One row per row: id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A text is its words (A-Z lower-cased) and an end; both scores are log10 probabilities of that sequence. The
    base is the unigram with one added. The model is a distribution over all texts: symbols in context, and the spelling of each word
    outside the code. Words of the code: the coded_words most frequent ones with at least `least` training occurrences.
    Classes: the most
    frequent beginnings of two bytes of rare words. All training rows are counted. The `hot` most frequent words are broadcast with their costs, all others meet their documents in
    a join on the word, a row for each occurrence. Tables are summed over tasks in a tree; their sizes, coded_words and
    hot are parameters that bound the driver and the broadcasts.

    Learns from rows whose crc32(id) mod 7 is not 2; null ids count as training rows. Null texts are empty (the end alone). Repeated
    rows are scored each, and alike; a very long text is scored whole; words that tie in frequency are ordered by their bytes; without
    rows there are none; other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    slim = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(f"`{text_col}`").alias("text"),
    )
    with small_batches(spark):
        vocab = settle(vocabulary(slim, "id", "text"))
        train = slim.where(training_rows(F.col("id"))).select("text")
        ends = train.count()
        sums = vocab.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
        total, distinct = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
        top = vocab.where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(coded_words)
        often = [(bytes(r["word"]), r["n"]) for r in top.collect()]
        frame = spark.createDataFrame(often, "word binary, n long")
        rare = settle(vocab.join(F.broadcast(frame), "word", "left_anti"))
        first = F.substring(F.concat("word", F.lit(b" ")), 1, CLASS).alias("first")
        groups = rare.where("n > 0").groupBy(first).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "first").limit(classes)
        groups = [(bytes(r["first"]), r["n"]) for r in groups.collect()]
        by_class = {c: RARE + 1 + k for k, (c, _) in enumerate(groups)}
        told = [ends, 0, *(n for _, n in groups), *(n for _, n in often)]
        told[RARE] = total - sum(told)
        code = WordCode(np.array(told), len(groups), table_bits)
        names = Symbols({END: END_SYMBOL} | {w: code.first_word + k for k, (w, _) in enumerate(often)}, by_class)

        order = F.col("n").desc(), "word"
        more = [(bytes(r["word"]), r["n"]) for r in rare.orderBy(*order).limit(hot).collect()]
        words = pa.array([END, *(w for w, _ in (*often, *more))], pa.binary())
        n = np.array([ends, *(n for _, n in (*often, *more))], float)
        spelt, wide, kind = 1 + len(often), np.dtype("<u4"), _kind(code)  # from `spelt` on words are spelled
        looked = spark.sparkContext.broadcast((words, names, np.append(names.of(words), RARE), np.append(np.log10(n + 1), 0.0), np.append(n > 0, False)))

        def look_up(batches):
            words, names, symbol, base, is_known = looked.value
            for piece in _pieces(batches):
                flat, lengths = split_words(piece.column("text"))
                at = _places(flat, words)
                symbols, missing = symbol.take(at), np.flatnonzero(at < 0)
                rest = flat.take(pa.array(missing))
                symbols[missing] = names.by_class(rest)
                ended, sizes = _ended(at, lengths, 0), lengths + 1
                start = np.cumsum(sizes) - sizes
                of_text = lambda found: np.add.reduceat(found, start, dtype=np.int64)
                cut = pa.array(np.append(0, np.cumsum(of_text(ended < 0))), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "row": piece.column("row"), "id": piece.column("id"), "n_bytes": piece.column("n_bytes"), "train": piece.column("train"),
                    "n_tokens": sizes, "n_known": of_text(is_known.take(ended)), "base": np.add.reduceat(base.take(ended), start),
                    "rare": pa.ListArray.from_arrays(cut, rest), "symbols": _binaries(_ended(symbols, lengths, END_SYMBOL).astype(kind), sizes),
                    "spelt": _binaries((ended[ended >= spelt] - spelt).astype(wide), of_text(ended >= spelt)),
                })

        # texts are split and their words looked up once: tables, weights and scores all read the symbols
        id_kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
        schema = f"row long, id {id_kind}, n_bytes long, n_tokens long, n_known long, base double, rare array<binary>"
        whole = slim.select(F.monotonically_increasing_id().alias("row"), "*", training_rows(F.col("id")).alias("train"))
        named_schema = f"row long, id {id_kind}, n_bytes long, train boolean, n_tokens long, n_known long, base double, rare array<binary>, symbols binary, spelt binary"
        named = settle(whole.mapInArrow(look_up, named_schema))

        width = train.rdd.getNumPartitions()
        tasks = max(2, min(width, max(spark.sparkContext.defaultParallelism, width // 8)))
        model = fit_symbols(named.where("train").select("symbols"), code, tasks)
        scored = settle(spelled(rare, fit_speller(rare, spell_bits, tasks), by_class))

        costs = np.array([r["bits"] for r in scored.orderBy(*order).limit(hot).select("bits").collect()], float)
        shared = spark.sparkContext.broadcast((model, costs))

        def read(batches):
            own, costs = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP):
                    part = batch.slice(at, GROUP)
                    (symbols, sizes), (rarer, how_many) = _numbers(part.column("symbols"), kind), _numbers(part.column("spelt"), wide)
                    cost = np.add.reduceat(own.log2(symbols, own.code.contexts(symbols, sizes)), np.cumsum(sizes) - sizes)
                    cost += np.bincount(np.repeat(np.arange(len(sizes)), how_many), costs.take(rarer), len(sizes))
                    yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {"bits": cost})

        kept = ["row", "id", "n_bytes", "n_tokens", "n_known", "base", "rare"]
        found = settle(named.select(*kept, "symbols", "spelt").mapInArrow(read, f"{schema}, bits double"))
        discard(named)
    asked = found.where(F.size("rare") > 0).select("row", F.explode("rare").alias("word"))
    met = asked.join(scored, "word").groupBy("row").agg(
        F.count_if(F.col("n") > 0).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_base"), F.sum("bits").alias("more_bits")
    )
    out = found.drop("rare").join(met, "row", "left")
    none = F.lit(0)
    all_bits = F.col("bits") + F.coalesce("more_bits", none)
    smooth = float(np.log10(total + distinct + 1))
    return out.select(
        "id",
        (~training_rows(F.col("id"))).alias("held_out"),
        "n_bytes",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none) - F.col("n_tokens") * smooth).alias("base_score"),
        (all_bits * float(np.log10(2))).alias("score"),
        F.when(F.col("n_bytes") > 0, -all_bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
