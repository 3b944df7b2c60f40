"""Columns over device signals: keys, uniform values and packet fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MOTION_REPORT_PORT = 4949
PICTURE_REPORT_PORT = 8080

# Uniform value of each safety state.
SAFETY_VALUES = {"ON": 1.0, "OFF": 0.0, "PULSE": 2.0, "BURST": 3.0}
# Safety devices by destination address, their digital outputs and the states.
SAFETY_DEVICES = {"132.8.7.101": "PBE", "132.8.7.102": "SBE"}
SAFETY_OUTPUTS = {
    "PBE": {0x0010: "1", 0x0027: "DO3_FIRE1", 0x0012: "DO2_MOTION", 0x0014: "DO4_LED_FIRE_EN"},
    "SBE": {0x0010: "DO0_RLD", 0x0011: "DO1_RLD_SFTY", 0x0012: "DO2_PWR", 0x0028: "DO4_FIRE2", 0x0015: "X5"},
}
SAFETY_STATES = {0x0000: "OFF", 0xFF00: "ON", 0x0001: "PULSE", 0x0003: "BURST"}
# Profile tokens and the power name the picture messages carry.
PICTURE_TOKENS = ("day", "night_combined")
RANGE_FINDER = "laser_range_finder"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def x_signal_key(pipe, description, is_cmd, axis=None) -> Column:
    """Lower-cased ``pipe|description|isCmd[|axis]``."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in
             (pipe, description, F.coalesce(is_cmd, F.lit(False)))]
    if axis is not None:
        parts.append(F.coalesce(axis.cast("string"), F.lit("")))
    return F.lower(F.concat_ws("|", *parts))


def x_motion_value(is_cmd: Column, value: Column) -> Column:
    """A command counts as 1, a report as its value, -1 when it has none."""
    return F.when(is_cmd, F.lit(1.0)).otherwise(F.coalesce(F.nanvl(value, F.lit(None)), F.lit(-1.0)))


def x_safety_value(state: Column) -> Column:
    """The number of a safety state, -1 for any other text."""
    return F.coalesce(literal_map(SAFETY_VALUES)[state], F.lit(-1.0))


def x_picture_value(description: Column, zoom: Column, measurement: Column) -> Column:
    """Requests count as 1, statuses as their measure."""
    return (F.when(description.isin("FOV_REQ", "LRF_REQ"), 1.0)
            .when(description == "FOV_STS", F.coalesce(F.nanvl(zoom, F.lit(None)), F.lit(-1.0)))
            .when(description == "LRF_STS", F.coalesce(F.nanvl(measurement, F.lit(None)), F.lit(-1.0)))
            .otherwise(-1.0))


def x_opcode_text(opcode: Column) -> Column:
    """``0x`` and four hex digits."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(opcode.cast("long")), 4, "0"))


def x_epoch_ms(ts: Column) -> Column:
    """X24."""
    return F.unix_millis(ts.cast("timestamp"))


def x_bytes(data: Column) -> Column:
    """Binary as text of one character a byte, which the functions below read:
    characters can be cut and numbered without going through hex."""
    return F.decode(data, "ISO-8859-1")


def x_uint(data: Column, start, length: int) -> Column:
    """Big-endian unsigned integer of ``length`` bytes of byte text at 1-based
    ``start``; null when the bytes are not all there."""
    at = start if isinstance(start, Column) else F.lit(start)
    total = None
    for i in range(length):
        byte = F.ascii(F.substring(data, at + i, F.lit(1))).cast("long") * 256 ** (length - 1 - i)
        total = byte if total is None else total + byte
    return F.when(F.length(data) >= at + (length - 1), total)


def x_ip_start(data: Column) -> Column:
    """1-based place of the first IPv4 header byte 0x45 among the first 32
    bytes that still leave 20 bytes after them; null if none."""
    at = F.instr(F.substring(data, 1, 32), "\x45")
    return F.when((at > 0) & (at <= F.length(data) - 20), at)


def x_nibble_length(byte: Column, high: bool) -> Column:
    """Header length in bytes from a nibble counting 32-bit words."""
    return (F.shiftright(byte, 4) if high else byte).bitwiseAND(15) * 4


def x_dotted(data: Column, start: Column) -> Column:
    """Four bytes at ``start`` as a dotted address."""
    return F.concat_ws(".", *[x_uint(data, start + i, 1).cast("string") for i in range(4)])


def x_motion_fields(payload: Column) -> dict[str, Column]:
    """Axis, opcode and the value bytes of a motion payload."""
    size = F.length(payload)
    return {
        "axis": x_uint(payload, 5, 1).cast("int"),
        "opcode": x_uint(payload, 6, 2).cast("int"),
        "data": F.when(size > 8, payload.substr(F.lit(8), size - 8)).otherwise(F.lit("")),
    }


def x_safety_fields(device: Column, output: Column, state: Column) -> dict[str, Column]:
    """Names of a device's output and state codes; unknown ones as hex text."""
    known = F.coalesce(*[
        F.when(device == name, literal_map(codes)[output.cast("int")])
        for name, codes in SAFETY_OUTPUTS.items()])
    return {
        "opCode": x_opcode_text(output),
        "description": F.coalesce(known, x_opcode_text(output)),
        "state": F.coalesce(literal_map(SAFETY_STATES)[state.cast("int")], x_opcode_text(state)),
    }


def x_envelope(text: Column) -> Column:
    """The first envelope, in either of its two spellings; null if none."""
    found = [F.regexp_extract(text, f"(?s)(<{ns}:Envelope.*?</{ns}:Envelope>)", 1) for ns in ("SOAP-ENV", "s")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def x_element(envelope: Column, name: str, attribute: str | None = None) -> Column:
    """Text or attribute of the first element of a local name, whatever its
    prefix; null if there is no such element. One pattern an element, as
    evaluating a document per field would parse the message again and again."""
    tag = rf"<(?:[\w.-]+:)?{name}(?=[\s/>])"
    found = rf"[^>]*?\s{attribute}\s*=\s*[\"']([^\"']*)" if attribute else r"[^>]*>([^<]*)"
    return F.when(envelope.rlike(tag), F.trim(F.regexp_extract(envelope, tag + found, 1)))


def x_picture_fields(token: Column, zoom: Column, power: Column, measured: Column) -> dict[str, Column]:
    """What a picture message says, from its elements. The first of token,
    zoom, power and measurement that is there decides; a token or power of
    another kind says nothing."""
    zoom = zoom.try_cast("double")
    measure = F.when(F.lower(measured).contains("error"), F.lit(-1000.0)).otherwise(measured.try_cast("double"))
    description = (
        F.when(token.isNotNull(), F.when(token.isin(*PICTURE_TOKENS), F.lit("FOV_REQ")))
        .when(zoom.isNotNull(), F.lit("FOV_STS"))
        .when(power.isNotNull(), F.when(power == RANGE_FINDER, F.lit("LRF_REQ")))
        .when(measure.isNotNull(), F.lit("LRF_STS")))
    return {
        "description": description,
        "zoom": F.when(description == "FOV_STS", zoom),
        "measurement": F.when(description == "LRF_STS", measure),
    }
