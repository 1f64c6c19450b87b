"""Source documents: checks on upload, preflight, chunks and repeated uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import cut, trim_all

# Limits of an upload, bytes looked at, and a chunk's length.
MAX_BYTES, SAMPLE_BYTES, CHUNK_CHARS = 12 * 1024 * 1024, 2_000_000, 6000
# What is counted in a file's bytes.
TEXT_SIGNS, FONT_SIGN, IMAGE_SIGN = r"(?<![A-Za-z0-9_])(?:BT|ET|Tj|TJ|Tf)(?![A-Za-z0-9_])", r"/Font(?![A-Za-z0-9_])", r"/Subtype\s*/Image(?![A-Za-z0-9_])"


def upload_error(name: Column, mime: Column, size: Column) -> Column:
    """Why a file isn't taken, null if it is."""
    pdf = F.lower(name).endswith(".pdf") & F.coalesce(mime, F.lit("")).isin("", "application/pdf", "application/octet-stream")
    return F.when(~F.coalesce(pdf, F.lit(False)), "NOT_PDF").when(size <= 0, "EMPTY").when(size > MAX_BYTES, "TOO_LARGE")


def is_pdf(content: Column) -> Column:
    """Whether a file begins as a PDF does."""
    return F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")


def sample_text(content: Column) -> Column:
    """The first bytes of a file, one sign a byte."""
    return F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")


def preflight(rows: DataFrame, text: Column) -> DataFrame:
    """Counts of text, font and image signs, and how the file should be read."""
    got = rows.withColumns({"n_text": F.regexp_count(text, F.lit(TEXT_SIGNS)), "n_font": F.regexp_count(text, F.lit(FONT_SIGN)), "n_image": F.regexp_count(text, F.lit(IMAGE_SIGN))})
    layer = (F.col("n_text") >= 3) | (F.col("n_font") >= 2)
    images = F.col("n_image") > F.greatest(F.lit(8), 2 * F.col("n_text"))
    mode = F.when(layer & images, "HYBRID").when(layer, "NATIVE_TEXT").otherwise("VISION_OCR_FALLBACK")
    return got.withColumns({"mode": mode, "confidence": F.when(layer & images, 0.72).when(layer, 0.82).otherwise(0.78)})


def chunks_of(text: Column, most: int = CHUNK_CHARS) -> Column:
    """A text's chunks: blocks between blank lines are packed together, longer ones cut into equal lengths.

    A fold over the lengths of one text's blocks finds where chunks begin; each is then joined once, so time goes
    with the text's length.
    """
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n+"), trim_all), lambda b: b != "")
    cut_up = lambda b: F.transform(F.regexp_extract_all(b, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)), lambda p: F.struct(p.alias("text"), (F.length(b) > most).alias("alone")))
    start = F.struct(F.expr("CAST(array() AS ARRAY<INT>)").alias("starts"), F.lit(0).alias("at"), F.lit(-1).alias("size"))

    def step(s: Column, p: Column) -> Column:
        n = F.length(p["text"])
        begins = p["alone"] | (s["size"] < 0) | (s["size"] + n + 2 > most)
        size = F.when(p["alone"], F.lit(-1)).when(begins, n).otherwise(s["size"] + 2 + n)
        return F.struct(F.when(begins, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"), (s["at"] + 1).alias("at"), size.alias("size"))

    def joined(pieces: Column) -> Column:
        begun = F.array(F.aggregate(pieces, start, step, lambda s: s["starts"]))
        last = lambda starts, i: F.coalesce(F.get(starts, i + 1), F.size(pieces))
        return F.transform(begun, lambda starts: F.transform(starts, lambda at, i: F.array_join(F.slice(pieces["text"], at + 1, last(starts, i) - at), "\n\n")))[0]

    return F.transform(F.array(F.flatten(F.transform(blocks, cut_up))), joined)[0]


def chunked(rows: DataFrame, text: Column, most: int = CHUNK_CHARS) -> DataFrame:
    """One row a chunk, with ``ordinal`` from 1, ``chunk`` and a hash of it."""
    got = rows.select("*", F.posexplode(chunks_of(text, most)).alias("ordinal", "chunk"))
    return got.withColumns({"ordinal": F.col("ordinal") + 1, "chunk_hash": F.sha2("chunk", 256), "chunk": cut("chunk", 12_000)})


def first_copies(rows: DataFrame, checksum: Column, order: Column) -> DataFrame:
    """Each checksum's first row and the number of its copies."""
    got = rows.withColumn("checksum", checksum)
    return got.groupBy("checksum").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def upload_verdicts(uploads: DataFrame, runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """What becomes of each upload: a run of this checksum exists, or a job that hasn't failed, or a failed one
    is started again, or a new one is made. The latest run counts, whatever its company."""
    last = Window.partitionBy("checksum").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    run = runs.withColumn("n_", F.row_number().over(last)).where("n_ = 1").select("checksum", "run_id")
    job = jobs.select("checksum", F.col("job_id").alias("found_job"), F.col("status").alias("job_status"))
    got = uploads.join(run, "checksum", "left").join(job, "checksum", "left")
    verdict = F.when(F.col("run_id").isNotNull(), "DUPLICATE_RUN").when(F.col("found_job").isNotNull() & (F.col("job_status") != "FAILED"), "DUPLICATE_JOB").when(F.col("found_job").isNotNull(), "RESET").otherwise("CREATE")
    return got.withColumn("verdict", verdict)
