"""Captured packets in, typed signal rows out."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boardsight.core.columns import once
from boardsight.functions import signals as fn
from boardsight.functions.commands import OPCODES
from boardsight.sources.signals import split_valid

CAPTURE_COLUMNS = "path string, n long, captured_us long, packet binary, reason string"
_CAPTURE_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
                  b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def _records(path: str, data: bytes) -> Iterator[tuple]:
    """The records of one capture file: (path, number, microseconds, bytes, None),
    and where it can't be read on (path, number, None, None, reason)."""
    known = _CAPTURE_MAGIC.get(bytes(data[:4]))
    if known is None:
        yield path, 0, None, None, "unknown kind of file"
        return
    order, per_us = known
    at, n = 24, 0
    while at + 16 <= len(data):
        seconds, fraction, kept, _ = struct.unpack_from(f"{order}IIII", data, at)
        if at + 16 + kept > len(data):
            break
        yield path, n, seconds * 1_000_000 + fraction // per_us, bytes(data[at + 16:at + 16 + kept]), None
        at, n = at + 16 + kept, n + 1
    if at != len(data):
        yield path, n, None, None, "cut off"


def _split_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "n", "captured_us", "packet", "reason"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows: list[tuple] = []
            for row in _records(path, data.as_buffer().to_pybytes()):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _captures(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(_split_captures, CAPTURE_COLUMNS)


def read_captures(spark: SparkSession, glob: str) -> DataFrame:
    """Every whole record of the capture files under ``glob``; what can't be
    read is in ``refused_captures``."""
    rows = _captures(spark, glob).filter("reason IS NULL")
    return rows.withColumn("timestamp", F.timestamp_micros("captured_us")).drop("captured_us", "reason")


def refused_captures(spark: SparkSession, glob: str) -> DataFrame:
    """Capture files of unknown kind and those cut off within a record:
    path, how many records were read (``n``), and the reason."""
    return _captures(spark, glob).filter("reason IS NOT NULL").select("path", "n", "reason")


def with_headers(packets: DataFrame, packet: str = "packet") -> DataFrame:
    """IPv4 and TCP/UDP fields of each packet, null where there is no header,
    and the ``payload`` as byte text. Each step is a column the next ones read,
    so no expression grows over the whole packet."""
    b, at, l4 = F.col("_b"), F.col("_ip"), F.col("_l4")
    df = packets.withColumn("_b", fn.x_bytes(F.col(packet)))
    df = df.withColumn("_ip", fn.x_ip_start(b))
    df = df.withColumns({
        "protocol": fn.x_uint(b, at + 9, 1).cast("int"),
        "src_ip": F.when(at.isNotNull(), fn.x_dotted(b, at + 12)),
        "dst_ip": F.when(at.isNotNull(), fn.x_dotted(b, at + 16)),
        "_l4": at + fn.x_nibble_length(fn.x_uint(b, at, 1).cast("int"), high=False),
    })
    df = df.withColumns({
        "src_port": fn.x_uint(b, l4, 2).cast("int"), "dst_port": fn.x_uint(b, l4 + 2, 2).cast("int"),
        "_u32": fn.x_uint(b, l4 + 4, 4),
        "_tcp": (l4 + fn.x_nibble_length(fn.x_uint(b, l4 + 12, 1).cast("int"), high=True)).cast("int"),
    })
    size = F.length(b)
    udp = F.least(F.floor(F.col("_u32") / 65536) - 8, size - (l4 + 7)).cast("int")
    return once(df, {
        **{c: F.col(c) for c in ("protocol", "src_ip", "dst_ip", "src_port", "dst_port")},
        "seq": F.when(F.col("protocol") == 6, F.col("_u32")),
        "payload": F.when(F.col("protocol") == 17, F.when(udp > 0, F.substring(b, l4 + 8, udp)))
                   .when(F.col("_tcp") <= size, F.substring(b, F.col("_tcp"), size)),
    }).drop("_b", "_ip", "_l4", "_u32", "_tcp")


def read_packets(spark: SparkSession, glob: str, port: int = fn.MOTION_REPORT_PORT) -> DataFrame:
    """TCP packets to ``port`` that carry a payload."""
    rows = with_headers(read_captures(spark, glob))
    return rows.filter((F.col("protocol") == 6) & (F.col("dst_port") == port) & (F.length("payload") > 0))


def endpoint_filter(protocol: str | None, endpoints: list[tuple[str | None, int | None]] = ()) -> Column:
    """protocol AND (any host) AND (any port); hosts and ports match either
    side. An empty group asks for nothing; ``http`` is TCP port 80."""
    name = (protocol or "").strip().lower()
    either = lambda side, values: F.col(f"src_{side}").isin(values) | F.col(f"dst_{side}").isin(values)
    clauses = []
    if name == "http":
        clauses += [F.col("protocol") == 6, either("port", [80])]
    elif name in ("tcp", "udp"):
        clauses.append(F.col("protocol") == {"tcp": 6, "udp": 17}[name])
    elif name not in ("", "any"):
        raise ValueError(f"unknown protocol {protocol!r}")
    hosts = [h for h, _ in endpoints if h and h.strip()]
    ports = [p for _, p in endpoints if p and p > 0]
    if hosts:
        clauses.append(either("ip", hosts))
    if ports:
        clauses.append(either("port", ports))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def opcode_table(spark: SparkSession) -> DataFrame:
    """The fixed command table (about 150 rows, so always broadcast)."""
    return F.broadcast(spark.createDataFrame(OPCODES, "opcode int, description string, sent string, returned string"))


def with_opcode(df: DataFrame) -> DataFrame:
    """Rows of known opcodes with their description and value types."""
    return df.join(opcode_table(df.sparkSession), "opcode")


def known_opcodes(df: DataFrame, dim: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F8: (rows that decode, rejects with a reason)."""
    dim = opcode_table(df.sparkSession) if dim is None else dim
    return _decodable(df.join(dim, "opcode", "left"))


def _decodable(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    missing = F.col("value").isNull() | F.isnan("value") if "value" in joined.columns else F.lit(False)
    return split_valid(joined, {
        "payload too short": F.col("opcode").isNull(),
        "unknown opcode": F.col("description").isNull(),
        "no decodable value": missing,
    })


def x_float32(bits: Column) -> Column:
    """The float a 32-bit pattern stands for, exactly, as a double."""
    exponent = F.shiftright(bits, 23).bitwiseAND(255)
    fraction = bits.bitwiseAND(0x7FFFFF)
    sign = F.when(bits >= 2 ** 31, -1.0).otherwise(1.0)
    return (F.when((exponent == 255) & (fraction > 0), F.lit(float("nan")))
            .when(exponent == 255, sign * F.lit(float("inf")))
            .when(exponent == 0, sign * fraction * F.lit(2.0 ** -149))
            .otherwise(sign * (1 + fraction / F.lit(2.0 ** 23)) * F.pow(F.lit(2.0), exponent - 127)))


def x_wire_value(kind: Column, data: Column) -> Column:
    """A value of the named wire type at the start of ``data``; null if short."""
    return (F.when(kind == "none", 1.0)
            .when(kind == "u8", fn.x_uint(data, 1, 1).cast("double"))
            .when(kind == "u16", fn.x_uint(data, 1, 2).cast("double"))
            .when(kind == "u32", fn.x_uint(data, 1, 4).cast("double"))
            .when(kind == "f32", x_float32(fn.x_uint(data, 1, 4))))


def motion_payload(packets: DataFrame, packet: str = "packet") -> DataFrame:
    """Payload (byte text) and source port of a motion packet: behind an IPv4
    header where one is found, else behind a bare TCP header, else the whole
    packet."""
    b, at, l4, size = F.col("_b"), F.col("_ip"), F.col("_l4"), F.length("_b")
    rows = packets.withColumn("_b", fn.x_bytes(F.col(packet))).withColumn("_ip", fn.x_ip_start(b))
    # without an IPv4 header the TCP header is taken to start the packet
    rows = rows.withColumn("_ip", F.when(size >= at + 39, at))
    rows = rows.withColumn("_l4", F.coalesce(at + fn.x_nibble_length(fn.x_uint(b, at, 1).cast("int"), high=False),
                                             F.when(size >= 20, F.lit(1))))
    rows = rows.withColumns({
        "src_port": F.coalesce(fn.x_uint(b, l4, 2), F.lit(0)).cast("int"),
        "_data": (l4 + fn.x_nibble_length(fn.x_uint(b, l4 + 12, 1).cast("int"), high=True)).cast("int"),
    })
    behind = F.when(F.col("_data") <= size, F.substring(b, F.col("_data"), size))
    whole = F.when(at.isNotNull(), behind).otherwise(F.coalesce(behind, b))
    return once(rows, {"src_port": F.col("src_port"), "payload": whole}).drop("_b", "_ip", "_l4", "_data")


def decode_motion(packets: DataFrame, packet: str = "packet") -> tuple[DataFrame, DataFrame]:
    """Motion rows, and the packets that do not decode with the reason."""
    rows = motion_payload(packets, packet).withColumn("payload", F.when(F.length("payload") >= 7, F.col("payload")))
    rows = once(rows, {**fn.x_motion_fields(F.col("payload")), "isCmd": F.col("src_port") != fn.MOTION_REPORT_PORT})
    typed = rows.join(opcode_table(packets.sparkSession), "opcode", "left")
    kind = F.when(F.col("isCmd"), F.col("sent")).otherwise(F.col("returned"))
    ok, rejects = _decodable(once(typed, {"value": x_wire_value(kind, F.col("data"))}))
    keep = [c for c in packets.columns if c != packet]
    motion = ok.select(
        *keep, fn.x_signal_key(F.lit("motion"), F.col("description"), F.col("isCmd"), F.col("axis")).alias("id"),
        "isCmd", fn.x_opcode_text(F.col("opcode")).alias("opCode"), "description", "axis", "value")
    return motion, rejects.select(*packets.columns, "reason")


def decode_safety(packets: DataFrame, packet: str = "packet", include_name: bool = False) -> DataFrame:
    """Safety rows of UDP packets to a known device."""
    headed = with_headers(packets, packet).filter((F.col("protocol") == 17) & (F.length("payload") >= 4))
    keep = [c for c in packets.columns if c != packet]
    size = F.length("payload")
    codes = once(headed, {"_do": fn.x_uint(F.col("payload"), size - 3, 2), "_st": fn.x_uint(F.col("payload"), size - 1, 2),
                          "name": fn.literal_map(fn.SAFETY_DEVICES)[F.col("dst_ip")]})
    fields = fn.x_safety_fields(F.col("name"), F.col("_do"), F.col("_st"))
    rows = codes.filter(F.col("name").isNotNull()).select(*keep, F.lit(True).alias("isCmd"), "name", *[c.alias(n) for n, c in fields.items()])
    name = F.concat_ws("/", "name", "description") if include_name else F.col("description")
    return rows.withColumn("id", fn.x_signal_key(F.lit("safety"), name, F.col("isCmd")))


def opcode_counts(df: DataFrame, by: str = "opcode") -> DataFrame:
    """Packets per opcode."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("packets"))
