"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, sieved, table, written
from .components import components

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles, repeats included; zero without words.

    A-Z is lower-cased and words are what stands between ASCII white space; a text of fewer words
    is one shingle. A bit is 1 if it is set in over half the XXH64 values.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, id_type: str = "long") -> DataFrame:
    """(doc_id, fp long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, f"doc_id {id_type}, fp long")


def hamming_links(fps: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` that differ in ``max_bits`` bits at most.

    Each fingerprint is cut into segments. Of ``max_bits`` differences some segment has at most
    ``max_bits // segments``, so probing each segment's table with every value of that small
    Hamming ball meets all partners; the whole distance is then verified in the join.
    """
    if segments != 2 or max_bits // segments > 1:
        raise ValueError("two segments of 32 bits and balls of radius 0 or 1 are supported")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    parts = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))
    index = fps.select(F.col("fp").alias("b"), F.explode(parts).alias("p")).select("b", "p.seg", "p.key")
    ball = [0] + ([1 << i for i in range(32)] if max_bits // segments == 1 else [])
    masks = F.array(*[F.lit(m).cast("long") for m in ball])
    probe = fps.select(F.col("fp").alias("a"), F.explode(parts).alias("p")).select(
        "a", "p.seg", F.explode(F.transform(masks, lambda m: F.col("p.key").bitwiseXOR(m))).alias("key")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probe.join(index.hint("merge"), ["seg", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def _components(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id) of every fingerprint: the smallest doc_id it is connected to."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    comp = components(hamming_links(nodes.select("fp"), max_bits)).withColumnRenamed("id", "fp")
    named = nodes.join(comp, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(first, "component").select("fp", "component_id")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) per row.

    Equal fingerprints are one node, so copies cost nothing in the join. Texts without words have
    fingerprint zero and link like any other. Null text is empty; rows with a null id are returned
    and never give a component its id; repeated rows each give a row; an empty table gives none.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fps")
    return fps.join(_components(fps, max_bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_filter(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id.

    All columns are kept. Rows with a null id stay only in a component without other ids; of rows
    that share an id, each is judged by its own text.
    """
    k1, k2 = free(docs, "k1", "k2")
    place = {k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), k2: F.xxhash64(F.coalesce("text", F.lit("")))}
    docs_ = docs.withColumns(place)
    # one id may have several texts: the place of each row in the search is (id, text)
    fps = written(fingerprints(docs_.select(F.struct(k1, k2).alias("place"), "text"), "place", "text", width, "struct<k1: long, k2: long>"), "fps")
    comp = written(_components(fps.select(F.col("doc_id.k1").alias("doc_id"), "fp"), max_bits), "comp")
    drop = fps.join(comp, "fp").where(F.col("doc_id.k1") != F.col("component_id"))
    drop = written(drop.select(F.col("doc_id.k1").alias(k1), F.col("doc_id.k2").alias(k2)).distinct(), "drop")
    maybe, rest = sieved(docs_, drop, k1, k2)
    return rest.unionByName(maybe.join(drop, [k1, k2], "left_anti")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
SQL: dict[str, str] = {}
