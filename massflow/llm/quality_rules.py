"""Quality rules: text counts and a calibrated hashed n-gram classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from massflow.llm import hashed_lr as lr
from massflow.llm import text as T
from massflow.llm.frames import release

#: Labelled rows of each class that the classifier is fitted on at most.
TRAIN_PER_CLASS = 1200
#: A document is kept at this calibrated probability of good quality or more.
KEEP_AT = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_p double, kept boolean"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> lr.Model | None:
    return lr.train(lr.labelled_sample(docs, labels, "quality", per_class), lr.class_counts(labels, "quality"))


def judge(docs: DataFrame, model: lr.Model | None, text_col: str = "text", prefix: str = "", keep_at: float = KEEP_AT) -> DataFrame:
    """docs with the counts, ``quality_p`` and ``kept`` appended, names after ``prefix``.

    A null or empty text has no words: its counts are 0 and base_failed holds.
    Without a model (no labels, or one class only) quality_p is 1 and the base
    rules decide alone.  Repeated rows are judged alike; ties do not arise; an
    empty table gives an empty result.  Other columns pass through, but for
    those named like an output, which takes their place; ``prefix`` avoids that.
    """
    docs = docs.drop(*(prefix + n for n in NAMES))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    schema = StructType(list(docs.schema))
    for f in FIELDS.split(", "):
        name, kind = f.split()
        schema = schema.add(prefix + name, kind)

    def run(batches):
        m = shared.value
        for b in batches:
            cols: dict[str, list[np.ndarray]] = {n: [] for n in NAMES}
            for _, _, buf, off in T.slices(b.column(text_col)):
                ph = T.PrefixHash(buf)
                w = T.words(buf, off, prefix=ph)
                got = T.rule_counts(buf, off, ph, w)
                n = got["n_words"]
                got["base_failed"] = (n < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                got["quality_p"] = m.probabilities(buf, off, w) if m is not None else np.ones(len(n))
                got["kept"] = ~got["base_failed"] & (got["quality_p"] >= keep_at)
                for k in NAMES:
                    cols[k].append(got[k])
            made = [pa.array(np.concatenate(v) if v else np.zeros(0), _arrow(k)) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *(prefix + k for k in NAMES)])
        b = cols = made = None  # noqa: F841  nothing of the last batch is held
        release()

    return docs.mapInArrow(run, schema)


def _arrow(name: str) -> pa.DataType:
    return pa.bool_() if name in ("base_failed", "kept") else pa.float64() if name == "quality_p" else pa.int64()


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with its counts and verdict, one row per row of docs."""
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of docs that pass, with docs' own columns (pipeline stage).

    The model is fitted on labelled rows of ``known``, or else of docs.  Null
    and empty texts go, as they have no words; repeated rows go or stay
    together; an empty table stays empty.  Columns of any names but those that
    begin with ``__rule_`` pass through.
    """
    p = "__rule_"
    return judge(docs, fit(docs if known is None else known, labels), prefix=p).where(F.col(p + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
