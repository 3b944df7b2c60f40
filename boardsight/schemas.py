"""One StructType per table; reads name the schema, never infer it."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
    StringType, StructField as Field, StructType, TimestampType,
)


def _table(**columns) -> StructType:
    return StructType([Field(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D, _B, _T = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType()

POINT = _table(x=_D, y=_D)
MATRIX = ArrayType(ArrayType(_D))
PLACE = _table(at=_T, template_to_picture=MATRIX)

SIGNALS = {
    "motion": _table(timestamp=_T, id=_S, isCmd=_B, opCode=_S, description=_S, axis=_I, value=_D),
    "onvif": _table(timestamp=_T, id=_S, isCmd=_B, description=_S, zoom=_D, measurement=_D),
    "safety": _table(timestamp=_T, id=_S, isCmd=_B, name=_S, opCode=_S, description=_S, state=_S),
}
MEASURES = {"motion": ["value"], "onvif": ["zoom", "measurement"], "safety": []}
SAMPLE = _table(key=_S, ts_ms=_L, value=_D)

RANGES = _table(id=_S, timestamp=_T, start_time=_L, end_time=_L, description=_S)
EVENTS = _table(id=_S, timestamp=_T, start_time=_L, end_time=_L, range_id=_S)
TARGETS = _table(id=_S, timestamp=_T, pos_x=_I, pos_y=_I, center_x=_I, center_y=_I)
HITS = _table(id=_S, timestamp=_T, range_to_target=FloatType(), pos_x=_I, pos_y=_I,
              center_x=_I, center_y=_I, target_id=_S, event_id=_S)

SESSIONS = _table(id=_S, name=_S, status=_S, started_at=_T, ended_at=_T, created_at=_T)
BULLET_HOLES = _table(
    id=_S, session_id=_S, camera_alias=_S, first_seen_at=_T, position_x=_D, position_y=_D,
    target_index=_I, x_mm=_D, y_mm=_D, source=_S, idempotency_key=_S, rank=_I, deleted_at=_T, created_at=_T)
RUNS = StructType([
    Field("id", _S), Field("session_id", _S), Field("camera_alias", _S), Field("taken_at", _T),
    Field("baseline_view", StructType([
        Field("template_to_picture", MATRIX),
        Field("targets", ArrayType(ArrayType(POINT))),
        Field("baseline_marks", ArrayType(POINT))])),
    Field("places", ArrayType(PLACE)), Field("watched_until", _T)])
CAMERAS = _table(id=_S, alias=_S, mcast_ip=_S, mcast_port=_I, iface=_S, enabled=_B, created_at=_T)

DETECTION = _table(cx=_D, cy=_D, w=_D, h=_D)
LOOKS = StructType([Field("recording", _S), Field("frame", _I), Field("status", _S),
                    Field("detections", ArrayType(DETECTION))])
PACKETS = StructType([
    Field("path", _S), Field("timestamp", _T), Field("src_ip", _S), Field("dst_ip", _S),
    Field("src_port", _I), Field("dst_port", _I), Field("seq", _L)])
