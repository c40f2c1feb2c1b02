"""The rejection of the language model is fitted on every training row."""

import numpy as np
from pyspark.sql import functions as F

from tablescout.llm import language_id as li


def test_all_training_rows_calibrate(spark):
    # every language has more rows than any sample would hold, and its oddest texts are few
    word = F.element_at(F.array(*[F.lit(w) for w in ("der", "Weg", "ist", "weit", "und", "breit")]), (F.col("id") % 6 + 1).cast("int"))
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"),
        F.when(F.col("id") % 2 == 0, F.concat_ws(" ", word, F.lit("Haus steht"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
        .otherwise(F.concat_ws(" ", F.lit("the house stands on"), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst"))).alias("text"))
    model = li.train(rows)
    sharp, bound = li.calibrate(rows, model)
    got = li.losses(rows.select(F.struct("lang").alias("row"), "text"), model).collect()
    loss = np.array([r.loss for r in got])
    truth = np.array([model.langs.index(r.row["lang"]) for r in got])
    z = {b: b * (loss - loss.min(axis=1, keepdims=True)) for b in li.SHARPNESS}
    nll = {b: np.mean(x[np.arange(len(x)), truth] + np.log(np.exp(-x).sum(axis=1))) for b, x in z.items()}
    assert sharp == min(nll, key=nll.get)
    for i in range(2):
        own = loss[(truth == i) & (loss.argmin(axis=1) == i), i]
        assert len(own) > 1000 and np.isclose(bound[i], np.quantile(own, 0.999) + li.MARGIN, rtol=0, atol=1e-9)


def test_tasks_hold_little_text_at_once(monkeypatch):
    import pyarrow as pa

    sizes, grams = [], li.Reader.grams
    monkeypatch.setattr(li.Reader, "grams", lambda self, texts: sizes.append(sum(map(len, texts))) or grams(self, texts))
    text = "some plain words " * 1000
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "text": [text] * 60})
    assert sum(b.num_rows for b in li._counter()([batch])) > 0
    assert sum(sizes) == 60 * len(text) and max(sizes) <= 1 << 18
