"""Language identification by compression.

For each language a raw-content dictionary is made of sample texts. A text is cut into blocks, each
block is compressed with every language's dictionary, and the language whose frames are the smallest
in total is chosen. Blocks are compressed each for itself, so that a long text can't outgrow the
dictionaries by its own repetitions. Only words count: case is folded and all other signs become a
space. Where the smallest and the next smallest total are close, the text is rejected.

A null text, an empty one, or one without a letter, is ``und`` with score 0, and rejected. Equal sizes, as very short
texts may have, go to the language with more labelled rows. With no labelled text, all are ``und``. Very long
texts are compressed whole, block by block; repeated rows are judged each for itself, and an empty table gives
an empty result. Other columns are kept but for ``lang_pred``, ``score`` and ``rejected``, which are set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: Labelled rows of each language that dictionaries are made from, at most, and bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 400, 48 << 10
#: Signs taken from one sample text, from a place given by its hash, so that many texts speak for a language; bytes of a dictionary, at least.
SAMPLE_SIGNS, LEAST_BYTES = 512, 8
LEVEL, BLOCK = 9, 1024
#: Least relative margin between the best and the second best total.
MARGIN = 0.005


Spec = tuple[tuple[str, bytes], ...]
OTHER = re.compile(r"[\W\d_]+")


def words(text: str) -> bytes:
    """Words in lower case with a space around each."""
    return f" {OTHER.sub(' ', text.lower())} ".encode()


def dictionaries(labelled: DataFrame, folds: int = 4, held: int = 2) -> Spec:
    """Languages and their dictionaries, those with more labelled rows first.

    They are made from rows with a ``lang`` outside the held-out fold, chosen by a hash of their text:
    at most ``SAMPLE_ROWS`` rows, ``SAMPLE_SIGNS`` signs of each and ``DICTIONARY_BYTES`` bytes for a language.
    A dictionary shorter than the format allows is filled up with spaces.
    """
    rows = (
        labelled.where((common.crc_fold("doc_id", folds) != held) & F.col("lang").isNotNull() & (F.length("text") > 0))
        .select("lang", F.expr(f"substring(text, cast(1 + pmod(xxhash64(text), greatest(length(text) - {SAMPLE_SIGNS}, 0) + 1) as int), {SAMPLE_SIGNS})").alias("text"), F.xxhash64("text").alias("h"))
        .groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("slot"))
        .agg(F.min_by("text", F.struct("h", "text")).alias("text"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    data: dict[str, bytes] = {}
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["slot"])):
        data[r["lang"]] = data.get(r["lang"], b"") + words(r["text"])
        seen[r["lang"]] = seen.get(r["lang"], 0) + r["n"]
    return tuple((k, data[k][-DICTIONARY_BYTES:].rjust(LEAST_BYTES)) for k in sorted(data, key=lambda k: (-seen[k], k)))


@lru_cache(maxsize=2)
def compressors(spec: Spec) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, data in spec:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def sizes(text: str, spec: Spec) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    raw = words(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum([len(c.compress(x)) for x in blocks]) for c in compressors(spec)]


def classify(docs: DataFrame, spec: Spec, margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` but those replaced, with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is a softmax of the compressed sizes' relative differences.
    """
    names = [k for k, _ in spec]
    common.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            lang, score, rejected = [], [], []
            for text in b.column("text").to_pylist():
                if not names or text is None or not any(map(str.isalpha, text)):
                    lang.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                got = np.array(sizes(text, spec), float)
                order = np.argsort(got, kind="stable")
                gain = (got - got.min()) / max(got.min(), 1.0)
                lang.append(names[order[0]])
                score.append(float(1 / np.exp(-40 * gain).sum()))
                rejected.append(len(order) > 1 and bool(gain[order[1]] < margin))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score), pa.array(rejected)], [*columns, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(common.lean(run), f"{kinds}, lang_pred string, score double, rejected boolean")
