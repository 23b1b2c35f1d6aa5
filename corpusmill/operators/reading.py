"""Reading parts of a corpus. C: DataFrame of (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import chunking
from corpusmill.functions import text as T

IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp")


def numbered(corpus: DataFrame, keys: tuple[str, ...] = ("path",), text: str = "text") -> DataFrame:
    """keys, line (from 1), text: a row for each line."""
    return corpus.select(*keys, F.posexplode(T.lines(F.col(text))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_lines(corpus: DataFrame, start: int | None = None, end: int | None = None, max_bytes: int = -1, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Numbered lines from start to end (both included), as "%6d<tab>text", while they and their line feeds fit in max_bytes."""
    df = numbered(corpus, keys)
    if start:
        df = df.where(F.col("line") >= start)
    if end:
        df = df.where(F.col("line") <= end)
    df = df.select(*keys, "line", F.concat(T.numbered(F.col("line")), F.lit("\t"), "text").alias("rendered"))
    if max_bytes >= 0:
        so_far = F.sum(F.octet_length("rendered") + 1).over(Window.partitionBy(*keys).orderBy("line"))
        df = df.withColumn("_n", so_far).where(F.col("_n") <= max_bytes).drop("_n")
    return df


class TooMany(ValueError):
    """More paths than a batch may have."""


def read_batch(corpus: DataFrame, paths: DataFrame, max_files: int = 20, max_bytes: int = 131072) -> DataFrame:
    """paths: pos, path. A row for each: its text, cut after max_bytes bytes (at a whole character) with a notice, or an error. More than max_files paths are refused."""
    wanted = paths.limit(max_files + 1).count()
    if wanted > max_files:
        raise TooMany(f"too many paths; a batch has {max_files} at most")
    df = paths.join(corpus, "path", "left")
    cut = F.concat(T.cut_bytes(F.col("text"), max_bytes), F.lit(f"\n[cut after {max_bytes} bytes]"))
    body = F.when(F.octet_length("text") > max_bytes, cut).otherwise(F.col("text"))
    return df.select("pos", "path", body.alias("text"), F.when(F.col("text").isNull(), F.lit("not found")).alias("error"))


def render_batch(batch: DataFrame) -> DataFrame:
    """One text: each part under "=== path ===", in order."""
    part = F.concat(F.lit("=== "), "path", F.lit(" ===\n"), F.coalesce("text", F.concat(F.lit("Error: "), "error")))
    return batch.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks without their text, with a summary."""
    return chunks.withColumn("summary", T.summary(F.col("text"))).drop("text")


def extract_chunks(corpus: DataFrame, max_tokens: int = chunking.MAX_TOKENS, clean: bool = True) -> DataFrame:
    """Cleaned texts in chunks: path, chunk_index, total, section, tokens, text."""
    text = T.clean(F.col("text")) if clean else T.normalize_ws(F.col("text"))
    return chunking.chunk_rows(corpus.withColumn("text", text), "text", max_tokens)


def read_documents(corpus: DataFrame, max_tokens: int = chunking.MAX_TOKENS, clean: bool = True) -> DataFrame:
    """Each text in one row if its tokens are few enough, else a row for each chunk with its summary: path, cleaned, tokens, text, chunk_index, total, section, summary."""
    each = corpus.withColumn("text", T.clean(F.col("text")) if clean else T.normalize_ws(F.col("text")))
    each = each.withColumn("tokens", T.estimate_tokens(F.col("text")))
    shown = F.when(F.col("text") == "", "(no extractable text)").otherwise(F.col("text"))
    none = {"chunk_index": "int", "total": "int", "section": "string", "summary": "string"}
    short = each.where(F.col("tokens") <= max_tokens).select("path", F.lit(clean).alias("cleaned"), "tokens", shown.alias("text"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    long = manifest(chunking.chunk_rows(each.where(F.col("tokens") > max_tokens).select("path", "text"), "text", max_tokens))
    return short.unionByName(long.select("path", F.lit(clean).alias("cleaned"), "tokens", F.lit(None).cast("string").alias("text"), *none))


def read_document(corpus: DataFrame, path: str, max_tokens: int = chunking.MAX_TOKENS, clean: bool = True) -> DataFrame:
    """read_documents of one path."""
    return read_documents(corpus.where(F.col("path") == path), max_tokens, clean)


def get_chunk(chunks: DataFrame, path: str, index: int) -> DataFrame:
    return chunks.where((F.col("path") == path) & (F.col("chunk_index") == index))


def read_images(files: DataFrame, max_bytes: int = 10 << 20, vision: bool = True) -> DataFrame:
    """files: path, content. path, size, base64 (one line) or an error: no vision model, not an image, too large."""
    size = F.octet_length("content").cast("long")
    error = F.when(F.lit(not vision), "the model can't see images").when(~T.extension(T.file_name(F.col("path"))).isin(*IMAGES), F.concat("path", F.lit(": not an image"))).when(size > max_bytes, F.concat("path", F.lit(f": larger than {max_bytes} bytes")))
    data = F.when(error.isNull(), F.regexp_replace(F.base64("content"), r"\s", ""))
    return files.select("path", size.alias("size"), data.alias("base64"), error.alias("error"))


def read_image(files: DataFrame, path: str, max_bytes: int = 10 << 20, vision: bool = True) -> DataFrame:
    """read_images of one path."""
    return read_images(files.where(F.col("path") == path), max_bytes, vision)


def byte_ranges(chunks: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Where each chunk stands in its document's stored text, chunks being parted by one byte."""
    before = Window.partitionBy(*keys).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return chunks.select(*keys, "chunk_index", start.cast("long").alias("byte_start"), (start + F.octet_length("text")).cast("long").alias("byte_end"))


def line_frequency(corpus: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Short lines that a document has three times or more, with their counts."""
    line = corpus.select(*keys, F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.btrim("line", F.lit(T.SPACE)))
    line = line.where((F.col("line") != "") & (F.octet_length("line") <= T.BOILERPLATE_BYTES))
    return line.groupBy(*keys, "line").agg(F.count("*").alias("n")).where(F.col("n") >= T.BOILERPLATE_TIMES)
