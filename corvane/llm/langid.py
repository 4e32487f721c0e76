"""Language ID by compression: the language whose zstandard raw-content dictionary encodes a text smallest.

Each language's dictionary is cut from a bounded, hash-ordered sample of its labelled texts (`dict_bytes` bytes of about `sample_docs`
texts). Every text, whatever its length, is then encoded whole with each language's dictionary at one and the same setting. Letters are
lower-cased first, in dictionaries and texts, so that capitals match. score is the margin between the two smallest encodings,
relative to the smallest; a text whose score is under `min_score` is marked rejected.

Defined edges: a null text or one without a letter is `und`, score 0. Ties go to the first language by name, with score 0 (rejected). With
one language only, every text with a letter has it, at score 1. With no labelled text at all every text is `und`. Repeated rows get equal
results, rows without doc_id are predicted but not learned from, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

UNKNOWN, MAX_LANGS = "und", 1024
PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, mod 3; 1 is held out. Rows without doc_id are in fold 1's complement, but are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def folded(text: str) -> bytes:
    return text.lower().encode()


def learn_dictionaries(labelled: DataFrame, dict_bytes: int = 65536, sample_docs: int = 400, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Per language, a raw-content dictionary of at most `dict_bytes` bytes.

    The driver keeps `dict_bytes` bytes a language, of `max_langs` languages at most (more are an error), from about `sample_docs` texts of
    each; texts longer than a dictionary are cut into chunks. The sample takes distinct texts by hash at a rate that follows from
    the number of the language's distinct texts, so it is spread over the whole table and copies do not thin it.
    """
    usable = labelled.where("lang is not null and length(trim(text)) > 0")
    step = max(1, dict_bytes // 4)  # characters of at most 4 bytes
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int"))
    chunks = F.when(F.octet_length("text") <= dict_bytes, F.array("text")).otherwise(F.transform(cuts, lambda i: F.substring(F.col("text"), i * step + 1, F.lit(step))))
    usable = usable.select("lang", F.explode(chunks).alias("text")).where("length(trim(text)) > 0").withColumn("key", F.xxhash64("text", F.lit(9)))
    counts = usable.select("lang", "key").distinct().groupBy("lang").count().withColumn("rate", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("count")))
    share = F.col("key").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    rates = {r["lang"]: r["rate"] for r in counts.orderBy("lang").limit(max_langs + 1).select("lang", "rate").collect()}  # max_langs + 1 rows at most
    if len(rates) > max_langs:
        raise ValueError(f"more than {max_langs} languages are labelled")
    if not rates:
        return {}
    rate = F.element_at(F.from_json(F.lit(json.dumps(rates)), "map<string,double>"), F.col("lang"))
    picked = usable.withColumn("share", share).where(F.col("share") < rate)
    parts: dict[str, list[bytes]] = {}
    for lang, text in picked.select("lang", "text").distinct().orderBy("lang", F.xxhash64("text")).toLocalIterator():
        own = parts.setdefault(lang, [])
        if sum(map(len, own)) < dict_bytes:
            own.append(folded(text))
    return {lang: b"\n".join(own)[:dict_bytes].ljust(8) for lang, own in sorted(parts.items())}  # 8 bytes are the least that the format takes


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    """An encoder at one fixed setting: greedy matches of 4 bytes or more over the dictionary and what came before in the text."""
    how = zstandard.ZstdCompressionParameters(
        window_log=22, chain_log=16, hash_log=17, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def decide(sizes: list[int], langs: list[str]) -> tuple[str, float]:
    """The language of the smallest size (the first of equals), and the margin to the next one."""
    if len(langs) == 1:
        return langs[0], 1.0
    best, second = sorted(sizes)[:2]
    return langs[sizes.index(best)], min(1.0, 4 * (second - best) / best)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_score: float = 0.02) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of docs."""
    langs = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [coder(dictionaries[lang]) for lang in langs]
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PREDICTIONS}
            for doc, text, letters in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "letters"))):
                lang, score = UNKNOWN, 0.0
                if letters and langs:
                    raw = folded(text)
                    lang, score = decide([len(c.compress(raw)) for c in coders], langs)
                for name, value in zip(out, (doc, lang, score, lang != UNKNOWN and score < min_score)):
                    out[name].append(value)
            yield batch_of(PREDICTIONS, **out)

    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn from rows outside fold 1, predict every row: doc_id, held_out, lang_pred, score, rejected."""
    rows = docs.select("doc_id", "text", "lang")
    learned = learn_dictionaries(rows.where(F.col("doc_id").isNotNull() & ~fold()))
    return classify(rows, learned).select("doc_id", fold().alias("held_out"), "lang_pred", "score", "rejected")
