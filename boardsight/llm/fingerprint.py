"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (a line with something on it, trimmed) has a vector of ``LANES`` numbers, and a
text's fingerprint is their sum modulo 2^32: the order of paragraphs does not count, and one is
inserted or deleted by adding or subtracting its vector. The first lanes hold a cryptographic
digest of the paragraph and decide equality; the others count its shingles of three words, each
as +1 or -1 in one lane (which no text that fits a row can fill), so that the distance of two fingerprints tells how much the texts share.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from boardsight.llm.common import small_batches

EQUAL, LIKE = 32, 256
LANES = EQUAL + LIKE
PART_BYTES = 32 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def fingerprint(text: str | None) -> np.ndarray:
    """The vector of a whole text; zero for null and for a text without paragraphs."""
    equal, words = np.zeros(EQUAL, dtype=np.uint64), []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        line = line.strip()
        if line:
            equal += np.frombuffer(hashlib.blake2b(line, digest_size=2 * EQUAL).digest(), dtype="<u2")
            words += line.split()
            words += (b"", b"")  # so that shingles end with the paragraph
    out = np.zeros(LANES, dtype=np.uint32)
    out[:EQUAL] = equal & 0xFFFFFFFF
    if words:
        h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
        s = h[:-2] * MIX[0] + h[1:-1] * MIX[1] + h[2:] * MIX[2]
        s = s[h[:-2] != 0]
        s = (s ^ (s >> np.uint64(29))) * MIX[3]
        sign = np.where(s >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        out[EQUAL:] = np.bincount((s >> np.uint64(56)).astype(np.int64), sign, LIKE).astype(np.int64) & 0xFFFFFFFF
    return out


def insert(vector: np.ndarray, paragraphs: str) -> np.ndarray:
    return vector + fingerprint(paragraphs)


def delete(vector: np.ndarray, paragraphs: str) -> np.ndarray:
    return vector - fingerprint(paragraphs)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; else the estimated share of common shingles (twice the common over the sum), 0 to 1."""
    if (a == b).all():
        return 1.0
    x, y, d = (v[EQUAL:].view(np.int32).astype(np.float64) for v in (a, b, a - b))
    both = x @ x + y @ y
    return min(1.0, max(0.0, 1.0 - d @ d / both)) if both else 0.0


def encode(vector: np.ndarray) -> str:
    return b64encode(vector.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by as many code points of the next one, and where the changed paragraphs start."""
    cut = len(text) - len(text) // 4
    return text[:cut] + following[: len(text) // 4], text.rfind("\n", 0, cut) + 1


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and that to the next document.

    The next document is the next by id; rows of equal id follow one another in order of a hash
    of their text, null ids come first, and after the last row comes the first. A null text is
    empty. One row comes back for each row.

    Rows are dealt to ranges of ids, each with the first row of the range after it as a guest, so
    texts are shuffled once and no task holds more than a batch of its range.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    narrow = rows.select("doc_id", "h", F.octet_length("text").alias("bytes"))
    spark = docs.sparkSession
    n, size = narrow.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART_BYTES + 1)
    bounds: list[int] = []
    if n:
        # Only the evenness of the ranges hangs on these, so they may be approximate.
        bounds = sorted(set(narrow.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    edges = np.array(bounds, dtype=np.float64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(dtype=np.float64, na_value=-np.inf) if str(ids.dtype)[0].isupper() else ids.astype(np.float64).fillna(-np.inf).to_numpy()
        return pd.Series(np.searchsorted(edges, x, side="right").astype(np.int32))

    # One row a range reaches the driver: its first row, the guest of the last filled range before it.
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    firsts = sorted((r["part"], r["k"]["known"], r["k"]["doc_id"], r["k"]["h"]) for r in narrow.groupBy(part_of("doc_id").alias("part")).agg(F.min(key).alias("k")).collect())
    guests = spark.createDataFrame([(firsts[i - 1][0], f[2], f[3], int(i == 0)) for i, f in enumerate(firsts)], "part int, doc_id long, h long, guest int")
    last = firsts[-1][0] if firsts else 0
    own = rows.select(part_of("doc_id").alias("part"), F.lit(0).alias("guest"), "doc_id", "h", "text")
    guest = rows.join(F.broadcast(guests.withColumnRenamed("doc_id", "g").withColumnRenamed("h", "gh")), F.expr("doc_id <=> g AND h = gh")).select(
        "part", F.lit(1).alias("guest"), "doc_id", "h", "text")
    dealt = own.unionByName(guest).repartitionById(last + 1, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "h")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before, out = None, []  # the row that waits for its next one: part, guest, id, text, vector
        for frame in frames:
            for part, is_guest, i, t in zip(frame["part"], frame["guest"], frame["doc_id"], frame["text"], strict=True):
                if before is not None and before[1] and is_guest and before[0] == part:
                    continue  # a repeated guest
                vector = fingerprint(t)
                if before is not None and before[0] == part and not before[1]:
                    out.append(_row(before[2], before[3], before[4], t, vector))
                before = (part, is_guest, i, t, vector)
            result = pd.DataFrame(out, columns=names)
            out = []
            yield result

    # Ids travel as text: pandas has no whole numbers beside nulls.
    out = small_batches(dealt).select("part", "guest", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _row(doc_id, text: str, vector: np.ndarray, following: str, its: np.ndarray) -> tuple:
    new, at = edited(text, following)
    changed = insert(delete(vector, text[at:]), new[at:])
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(vector),
            encode(changed), likeness(vector, changed), likeness(vector, its))
