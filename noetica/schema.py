"""Record types of the engine; every timestamp is UTC."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EPISODE = _struct(uuid=T.StringType(), name=T.StringType(), content=T.StringType(), source=T.StringType(), source_description=T.StringType(), reference_time=T.TimestampType(), group_id=T.StringType(), saga=T.StringType(), turn_index=T.IntegerType())
ENTITY = _struct(uuid=T.StringType(), name=T.StringType(), labels=STRINGS, summary=T.StringType(), created_at=T.TimestampType(), group_id=T.StringType())
EDGE = _struct(uuid=T.StringType(), source_uuid=T.StringType(), target_uuid=T.StringType(), name=T.StringType(), fact=T.StringType(), created_at=T.TimestampType(), valid_at=T.TimestampType(), invalid_at=T.TimestampType(), expired_at=T.TimestampType(), episodes=STRINGS, group_id=T.StringType())
SOURCE = _struct(source=T.StringType(), label=T.StringType(), raw_content=T.StringType(), created_at=T.StringType())
NOTE = _struct(name=T.StringType(), date=T.StringType(), body=T.StringType())
