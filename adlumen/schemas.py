"""Declared schemas of every input and stored table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in types.items()])


TEXT, LONG, INT, REAL, YES_NO = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TEXTS = T.ArrayType(TEXT)

POSTS = _fields(
    post_id=LONG, text_content=TEXT, language=TEXT, impressions=LONG, likes_count=LONG, shares_count=LONG,
    comments_count=LONG, sentiment_score=REAL, toxicity_score=REAL, buzz_change_rate=REAL,
)
BRAND = _fields(
    brand_id=TEXT, brand_name=TEXT, tone_category=TEXT, brand_voice_summary=TEXT, style_rules=TEXTS,
    preferred_vocabulary=TEXTS, forbidden_vocabulary=TEXTS, reference_ad_copies=TEXTS,
)
BRAND_FILE = T.StructType([T.StructField("brands", T.ArrayType(BRAND), True)])
BRAND_FORM = _fields(
    brand_id=TEXT, brand_name=TEXT, tone_category=TEXT, brand_voice_summary=TEXT, style_rules=TEXT,
    preferred_vocabulary=TEXT, forbidden_vocabulary=TEXT, reference_ad_copies=TEXT,
)
VARIANTS = _fields(request_id=LONG, variant_ord=INT, style=TEXT, text=TEXT, error=TEXT)
CACHE = _fields(cache_key=TEXT, model=TEXT, prompt=TEXT, text=TEXT, created_at=T.TimestampType())
IMPORTANCES = _fields(subset=TEXT, feature_ord=INT, feature=TEXT, importance=REAL)
METRICS = _fields(metric=TEXT, subset=TEXT, model=TEXT, value=REAL)


def human_eval(brands: list[str]) -> T.StructType:
    """Evaluation table with one score column per brand."""
    fields = [("idx", INT), ("source_brand", TEXT), ("language", TEXT), ("text", TEXT)]
    fields += [(f"score_{b}", REAL) for b in brands]
    fields += [("sbert_predicted_brand", TEXT), ("sbert_correct", YES_NO), ("human_label", TEXT)]
    return T.StructType([T.StructField(n, k, True) for n, k in fields])


def brand_proof(brands: list[str]) -> T.StructType:
    """Proof table with one score column per brand."""
    fields = [("text", TEXT), ("language", TEXT), ("source_brand", TEXT)]
    fields += [(f"score_{b}", REAL) for b in brands]
    fields += [("own_score", REAL), ("max_cross_score", REAL), ("own_higher_than_cross", YES_NO)]
    return T.StructType([T.StructField(n, k, True) for n, k in fields])
