"""Operator 10, language identification by compression.

For each language a dictionary of raw text is cut from a bounded sample of labelled documents. A text is
compressed with each dictionary; the language whose dictionary makes it smallest is the prediction. A narrow
margin to the second is reported as not accepted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import pieces, read, texts_of, written

#: The fit takes so many labelled documents for each language, at most, in hash order; from each of them so many
#: pieces of so many characters, at most, drawn from the whole text. A dictionary has so many bytes at most, and
#: all of them together TOTAL: with more languages than fit, each has a smaller one. All languages are learned.
SAMPLE_DOCS, PIECES, PIECE_CHARS, DICTIONARY, TOTAL = 400, 32, 280, 112 << 10, 24 << 20
LEVEL = 6
#: A text is compressed in blocks of so many bytes, each with the dictionary: in one long block the text's own
#: past would stand in for the dictionary after a while.
BLOCK = 1 << 10
#: Bits per byte that a margin must have to be accepted.
MARGIN = 0.02


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows (lang not null, text not empty).

    Labelled rows are counted over all documents; a hash of key and text then keeps about four times the sample
    of each language, and the sample is the first of those in hash order. Each sampled document gives pieces from
    anywhere in its whole text: all of them where there are PIECES or fewer, else PIECES in places drawn by hash.
    A dictionary takes the first piece of every document, then the second of every one, until it is full. So it
    doesn't depend on partitions, and what is shuffled for a language is bounded by the parameters above, whatever
    the input and the length of its texts. Equal pieces stand once. {} for an empty table.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.trim(text) != "")).select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("count")), "language-counts")
    labels = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").collect()]
    if not labels:
        return {}
    size = min(DICTIONARY, TOTAL // len(labels))
    share = F.least(F.lit(1.0), 4.0 * SAMPLE_DOCS / F.col("count"))
    rows = rows.join(counts, "lang").where(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40))
    n = F.ceil(F.length("t") / PIECE_CHARS)
    turn = lambda i: F.when(n <= PIECES, F.pmod(F.pmod("h", n) + i, n)).otherwise(F.pmod(F.xxhash64("h", i), n))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), turn))
    cut = F.transform(places, lambda at: F.expr("t").substr((at * PIECE_CHARS + 1).cast("int"), F.lit(PIECE_CHARS)))
    rows = rows.select("lang", "h", cut.alias("cut"))
    first = Window.partitionBy("lang").orderBy("h", "cut")
    rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS)
    rows = rows.select("lang", "n", F.posexplode("cut").alias("turn", "piece"))
    # A piece has a byte or more for each of its characters; only the last of a text and pieces with few letters are shorter.
    enough = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "n"))
    rows = rows.withColumn("place", enough).where(F.col("place") <= 4 * max(SAMPLE_DOCS, size // PIECE_CHARS))
    held: dict[str, list] = {}
    for r in rows.select("lang", "place", "piece").collect():
        held.setdefault(r["lang"], []).append((r["place"], r["piece"]))
    out = {}
    for name in labels:  # The commonest language first: it wins ties.
        texts = [x.strip() for x in letters_of(pa.array([t for _, t in sorted(held.get(name, []))], pa.string())).to_pylist()]
        plain = b" ".join(x.encode() for x in dict.fromkeys(texts) if x)[:size]
        if plain:
            out[name] = plain
    return out


def letters_of(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with one space for each run of other characters than letters."""
    return pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\p{L}]+", " "))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs without the text, with lang_pred, score and accepted.

    `und`, score 0 and not accepted for null texts, texts without a letter, and when no language was learned.
    Otherwise the language with the smallest output (ties go to the first in `dictionaries`, which `fit` orders by
    the number of labelled documents); score is from 0 to 1,
    0.5 for a tie, and accepted says whether the margin is wide enough. Whole texts are compressed, however
    long. Equal texts get equal results. Columns of docs with one of the three names are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "accepted")]
    fields = [docs.schema[c] for c in rest] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # TOTAL bytes at most
    names = list(dictionaries)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        for name in names:
            held = zstandard.ZstdCompressionDict(shared.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        for piece in pieces(batches, text):
            texts = texts_of(piece, text)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            pred, score, sure = [], [], []
            plain = letters_of(texts).cast(pa.binary()).to_pylist()
            for t, letter in zip(plain, letters, strict=True):
                if not letter or not packers:
                    pred.append("und")
                    score.append(0.0)
                    sure.append(False)
                    continue
                t = b" " + t.strip() + b" "
                blocks = [t[i : i + BLOCK] for i in range(0, len(t), BLOCK)]
                size = [sum(len(p.compress(b)) for b in blocks) for p in packers]
                order = np.argsort(size, kind="stable")
                gap = (size[order[1]] - size[order[0]]) * 8 if len(size) > 1 else 8 * len(t)
                pred.append(names[order[0]])
                score.append(1 / (1 + math.exp(-min(50.0, gap / 16))))
                sure.append(gap >= margin * len(t) and gap > 0)
            yield pa.RecordBatch.from_pydict({c: piece.column(c) for c in rest} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(sure, pa.bool_())})

    return docs.select(*rest, text).mapInArrow(predict, StructType(fields))


def held_out():
    """Whether a document is kept from learning: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return classify(rows, learned).select("doc_id", "held_out", "lang_pred", "score", "accepted")
