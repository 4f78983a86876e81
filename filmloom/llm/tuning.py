"""What the fixed parameters of op4 and op8 are chosen by: folds inside the training rows. Held-out rows take no part.

``python -m filmloom.llm.tuning SF_DIR`` prints a line for each choice.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm import lm, toxicity
from filmloom.llm.registry import table

WORTHS = [(300.0, 10.0), (1000.0, 3.0), (1000.0, 10.0), (3000.0, 3.0), (3000.0, 10.0), (3000.0, 30.0), (10000.0, 1.0), (10000.0, 3.0), (10000.0, 10.0), (30000.0, 3.0)]
SHARES = {
    "as it is": {}, "no misspellings": {"misspelled": 0.0}, "misspellings in full": {"misspelled": 1.0}, "quotation does not matter": {"quoted": 1.0}, "quotation in half": {"quoted": 0.5}, "quoted terms do not count": {"quoted": 0.0},
    "crowded from 2": {"crowded": 2}, "crowded from 6": {"crowded": 6}, "never crowded": {"crowded": 1 << 30},
}


def remainder(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def lm_folds(docs: DataFrame, worths: list[tuple[float, float]] = WORTHS, fold: int = 3) -> list[tuple[tuple[float, float], float]]:
    """(worths, log10 a token of the training rows with remainder ``fold``), learnt from the other training rows."""
    own = docs.select("doc_id", "text").where(~lm.held_out(F.col("doc_id")))
    out = []
    for w in worths:
        s = lm.scores(own, remainder("doc_id", 5) != fold, worths=w).where(remainder("doc_id", 5) == fold)
        r = s.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
        out.append((w, r["s"] / r["n"]))
    return out


def toxicity_folds(docs: DataFrame, labels: DataFrame, choices: dict[str, dict] = SHARES, limit: float = 0.7) -> list[tuple]:
    """(choice, toxic rows, of these found, clean rows, of these flagged, log loss a row) over both folds of the training rows, each learnt from the other."""
    out = []
    for name, choice in choices.items():
        total = [0, 0, 0, 0, 0.0]
        for fold, other in ((0, 2), (2, 0)):
            scorer = toxicity.learn(docs, labels.where(remainder("doc_id", 3) == fold), **choice)
            test = docs.select("doc_id", "text").join(labels.where((remainder("doc_id", 3) == other) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic"), "doc_id")
            p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("toxicity")))
            loss = -F.when(F.col("toxic") == 1, F.log(p)).otherwise(F.log(1 - p))
            hit = F.col("toxicity") >= limit
            r = toxicity.with_scores(test, scorer).agg(F.sum("toxic"), F.count_if(hit & (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 0), F.count_if(hit & (F.col("toxic") == 0)), F.sum(loss)).first()
            total = [a + (b or 0) for a, b in zip(total, r, strict=True)]
        out.append((name, *total[:4], total[4] / max(1, total[0] + total[2])))
    return out


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, sf_dir, "documents")
    for name, toxic, found, clean, flagged, loss in toxicity_folds(docs, table(spark, sf_dir, "labels")):
        print(f"op8 {name}: {found} of {toxic} toxic found, {flagged} of {clean} clean flagged, log loss {loss:.5f}", flush=True)
    for w, score in lm_folds(docs):
        print(f"op4 worths {w}: {score:.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
