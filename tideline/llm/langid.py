"""Language identification by hierarchical discrimination.

Linear support vector machines tell language families apart first; within the family chosen, one machine for each pair of
its languages votes. Features are hashed n-grams of the bytes of lower-cased letters, words kept apart by a space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, table

#: Families of ISO 639-1 codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
BITS, ORDERS, SCALE = 16, (3, 4), 20.0
PIECE = 1 << 20


def family(lang: str) -> str:
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), f"={lang}")


def cleaned(text_col: str):
    """Lower-cased letters with single spaces between and around words, as bytes; null becomes empty."""
    return F.regexp_replace(F.lower(F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit("")), F.lit(" "))), r"[^\p{L}]+", " ").cast("binary")


def buckets(buf: np.ndarray, n: int, starts: int) -> np.ndarray:
    """Hash buckets of the n-grams of `buf` that begin at its first `starts` bytes."""
    v = buf[:starts].astype(np.uint32)
    for k in range(1, n):
        v |= buf[k : starts + k].astype(np.uint32) << np.uint32(8 * k)
    return ((v * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)


def pieces(text: bytes):
    """(n-gram buckets) of a text, a bounded piece at a time."""
    buf = np.frombuffer(text, dtype=np.uint8)
    for a in range(0, max(1, len(buf)), PIECE):
        for n in ORDERS:
            m = min(PIECE, len(buf) - n + 1 - a)
            if m > 0:
                yield buckets(buf[a : a + PIECE + n], n, m)


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their share of its n-grams, times SCALE."""
    total = np.zeros(1 << BITS)
    for b in pieces(text):
        total += np.bincount(b, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] * (SCALE / max(1.0, total.sum()))).astype(np.float32)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0, epochs: int = 15, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with hinge loss, by dual coordinate descent until no row moves by `tol`; y is 1 or -1. Classes weigh alike."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha, rng = np.zeros(len(y)), np.random.default_rng(7)
    norm = np.array([float(v.astype(np.float64) @ v) + 1.0 for _, v in rows])
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(y)):
            at, v = rows[k]
            g = y[k] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[k] - g / norm[k], 0.0), most[k])
            d = (new - alpha[k]) * y[k]
            if d:
                w[at] += d * v
                bias += d
                alpha[k] = new
                moved = max(moved, abs(d))
        if moved < tol:
            break
    return w, bias


@dataclass
class Model:
    """Learned languages by family, and one linear function a column: families against the rest, then pairs within each."""

    families: list[tuple[str, list[str]]]
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[int, int, int]]  # (family, first language, second language) of the columns after the families'

    def decide(self, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores for rows of margins."""
        nf, sure = len(self.families), 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
        fam = np.argmax(margin[:, :nf], axis=1) if nf > 1 else np.zeros(len(margin), dtype=int)
        lang, score = np.empty(len(margin), dtype=object), np.ones(len(margin))
        for f, (_, langs) in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            votes, total, least = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for k, (g, a, b) in enumerate(self.pairs, nf):
                if g == f:
                    m, p = margin[rows, k], sure[rows, k]
                    votes[:, a] += m >= 0
                    votes[:, b] += m < 0
                    total[:, a] += np.tanh(m)
                    total[:, b] -= np.tanh(m)
                    least[:, a], least[:, b] = np.minimum(least[:, a], p), np.minimum(least[:, b], 1 - p)
            best = np.argmax(votes + total / (4 * len(langs)), axis=1)
            lang[rows] = np.array(langs, dtype=object)[best]
            score[rows] = least[np.arange(len(rows)), best] * (sure[rows, f] if nf > 1 else 1.0)
        return lang.tolist(), score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, most: int = 20_000, most_bytes: int = 64 << 20) -> Model | None:
    """Fits a model to a bounded sample of `docs`: of each language the `per_lang` rows whose ids hash lowest, fewer where there are so
    many languages that this would exceed `most` rows, or where the rows before have a language's share of `most_bytes` of text. Rows with a null language or without a letter teach nothing. None if no row is left.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    each = max(20, min(per_lang, most // len(sizes)))
    # Hashes below a threshold of each language give a little more than is wanted; the lowest of these are taken.
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, (each + 6 * each**0.5 + 10) / v)))])
    h = F.xxhash64(F.coalesce("id", F.lit("")))
    some = rows.withColumn("h", h).where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < share[F.col("lang")]).select("lang", "h", cleaned("text").alias("t"))
    some = some.where("octet_length(t) > 1").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= each)
    before = F.sum(F.least(F.octet_length("t"), F.lit(1 << BITS))).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max(1 << BITS, most_bytes // len(sizes)))

    def features(batches):
        for b in batches:
            got = [sparse(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["lang", "h", "at", "v"])

    got = some.select("lang", "h", "t").mapInArrow(features, "lang string, h long, at array<int>, v array<float>").toArrow()
    order = got.select(["lang", "h"]).to_pandas().sort_values(["lang", "h"], kind="stable").index
    langs = np.array(got.column("lang").to_pylist(), dtype=object)[order]
    at, v = got.column("at").combine_chunks(), got.column("v").combine_chunks()
    del got
    rows = [(at[int(k)].values.to_numpy(), v[int(k)].values.to_numpy()) for k in order]
    if not rows:
        return None
    names = sorted(set(langs))
    families = [(f, [x for x in names if family(x) == f]) for f in sorted({family(x) for x in names})]
    of = np.array([family(x) for x in langs])
    columns, pairs = [], []
    for f, _ in families:
        columns.append(svm(rows, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(1 << BITS), 0.0))
    for k, (_, ls) in enumerate(families):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls)):
                own = np.flatnonzero((langs == ls[a]) | (langs == ls[b]))
                columns.append(svm([rows[x] for x in own], np.where(langs[own] == ls[a], 1.0, -1.0)))
                pairs.append((k, a, b))
    return Model(families, np.stack([w for w, _ in columns], axis=1).astype(np.float32), np.array([b for _, b in columns]), pairs)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with two more columns, lang_pred and score (0 to 1): the language of each whole text.

    Only the text is looked at. A text that is null or has no letter is `und` with score 0, and so is every text if there is no model.
    Columns that are named lang_pred or score already are replaced. Repeated rows stay; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    sent = docs.select("*", cleaned(text_col).alias("_letters"), letters.alias("_some"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 weights

    def run(batches):
        m = known.value
        for b in batches:
            texts, some = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_pylist()
            n = len(some)
            lang, score = ["und"] * n, np.zeros(n)
            if m is not None and n:
                total, count = np.zeros((n, m.weights.shape[1])), np.zeros(n)
                for k, t in enumerate(texts):
                    if some[k]:
                        for at in pieces(t.as_py()):
                            total[k] += np.take(m.weights, at, axis=0).sum(axis=0, dtype=np.float64)
                            count[k] += len(at)
                got, sure = m.decide(total * (SCALE / np.maximum(count, 1))[:, None] + m.bias)
                lang, score = [g if s else "und" for g, s in zip(got, some)], np.where(some, sure, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-2], "lang_pred", "score"])

    shape = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return sent.mapInArrow(run, shape)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: a third of all ids, by their checksum. A null id counts as an empty one."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
