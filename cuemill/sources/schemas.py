"""Row types of the files that pass between jobs."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()

ARTICLES = _struct(url=_S, title=_S, description=_S, publishedAt=TimestampType())
SCORED_ARTICLES = _struct(url=_S, title=_S, description=_S, publishedAt=TimestampType(),
                          relevance_score=_I)
FULL_TEXT = _struct(url=_S, title=_S, text=_S)
SENTENCES = _struct(url=_S, sentence=_S)
EXTERNAL_CLEAN = _struct(sentence=_S, label=_I, hedge=_I, date=_S, stock_symbol=_S, publisher=_S,
                         url=_S)
# Labels stay text until rejected rows are dropped: "0", "1", "delete", "?".
ANNOTATIONS = _struct(id=_S, sentence=_S, url=_S, rule_pred=_I, gold_label=_S)
GOLD = _struct(id=_S, sentence=_S, url=_S, gold_label=_I)
TRAINING = _struct(sentence=_S, label=_I, source=_S)
FOLD_INDEX = _struct(fold=_I, train_indices=ArrayType(_L), val_indices=ArrayType(_L))
DUAL_ANNOTATOR = _struct(sentence=_S, annotator_1=_I, annotator_2=_I)
METRICS = _struct(accuracy=_D, precision=_D, recall=_D, f1=_D, tp=_L, tn=_L, fp=_L, fn=_L)
