"""Schemas of books, fingerprints, groups and bin entries. Missing text is '', only covers may be null."""

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FINGERPRINT = _struct(isbn_normalized=S, title_key=S, author_key=S, title_author_key=S, size_hash=S, simhash=L, text_preview=S)

BOOK = _struct(
    title=S, author=S, publisher=S, publish_date=S, isbn=S, language=S, description=S, tags=T.ArrayType(S), cover_path=S, file_path=S, file_format=S,
    file_size=L, fingerprint=FINGERPRINT, original_path=S, is_duplicate=B, duplicate_group_id=S, keep_recommendation_score=D, metadata_completeness=D,
)

GROUP = _struct(group_id=S, match_type=S, similarity=D, n_books=L)
ENTRY = _struct(id=S, original_path=S, recycle_path=S, file_name=S, file_size=L, deleted_at=S, metadata=T.MapType(S, S))
VERDICT = _struct(is_same_book=B, author_confidence=D, title_confidence=D, overall_confidence=D, reasons=T.ArrayType(S), severity=S)
