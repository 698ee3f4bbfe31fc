"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CAPTURE = _struct(source_key=_S, source_type=_S, run_id=_S, fetched_at=_TS, url=_S, page_no=_I, status=_I, body=_S)

POSTING = _struct(
    source_key=_S, native_id=_S, title=_S, url=_S, company=_S, locations=T.ArrayType(_S), posted_at=_TS,
    posted_precision=_S, description=_S, source_type=_S, kind=_S, multi_location=_B,
)
# Columns the pipeline adds to a posting.
DECIDED = _struct(
    first_seen=_TS, score=_I, family=_S, reason=_S, experience=_S, already_alerted=_B, also_on=T.ArrayType(_S),
    coverage_match=_B, target=_S, decision=_S,
)
SEEN = _struct(
    key=_S, first_seen=_TS, last_seen=_TS, title=_S, company=_S, url=_S, loc=_S, posted_at=_TS, fp=_S, src=_S, tgt=_S,
    baseline=_B, notified=T.MapType(_S, _TS), also_on=T.ArrayType(_S), family=_S, score=_I, dup_of=_S,
)
NOTIFIED = _struct(key=_S, grp=_S, ts=_TS)
VERDICT = _struct(key=_S, criteria=_S, score=_I, family=_S, front_office=_B, experience=_S, reason=_S)
FETCH_LOG = _struct(run_id=_S, source_key=_S, ts=_TS, ok=_B, skipped=_B, error=_S, jobs=T.LongType(),
                    seconds=T.DoubleType())
STATUS_EVENT = _struct(id=_S, seq=T.LongType(), day=T.DateType(), status=_S, manual=_B)
GEO = _struct(alias=_S, iso2=_S, kind=_S, population=T.LongType())
PLACE = _struct(ord=_I, country=_S, city=_S, aliases=T.ArrayType(_S), include_remote=_B, label=_S)

DATE_PRECISIONS = ("datetime", "date", "relative", "unknown")
KINDS = ("job", "page_change")
