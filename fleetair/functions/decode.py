"""Raw captured frames to physical units, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetair.schema import (
    CALIBRATION_BYTES,
    FRAME_BYTES,
    GAS_VALID_BIT,
    HEATER_STABLE_BIT,
    NEW_DATA_BIT,
)


def _bytes_to_int(hexed: Column, first: int, n: int = 1) -> Column:
    """``n`` bytes from byte ``first`` of a hex string, big-endian, unsigned."""
    return F.conv(F.substring(hexed, 2 * first + 1, 2 * n), 16, 10).cast("int")


def _signed(value: Column, bits: int) -> Column:
    half, full = 1 << (bits - 1), 1 << bits
    return F.when(value >= half, value - full).otherwise(value)


def split_frames(df: DataFrame, col: str = "frame", n: int = 3) -> DataFrame:
    """A capture of ``n`` concatenated frames becomes ``n`` rows with a ``slot``."""
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.substring(F.col(col), i * FRAME_BYTES + 1, F.lit(FRAME_BYTES)),
    )
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(frames).alias("slot", col))


def decode_frame(df: DataFrame, col: str = "frame") -> DataFrame:
    """Status, indices and raw counts of one 17-byte frame.

    A frame of another length decodes to NULLs.
    """
    h = F.when(F.length(col) == FRAME_BYTES, F.hex(col))
    first, last = _bytes_to_int(h, 0), _bytes_to_int(h, 16)
    return df.withColumns({
        "status": first.bitwiseAND(F.lit(NEW_DATA_BIT)).bitwiseOR(
            last.bitwiseAND(F.lit(GAS_VALID_BIT | HEATER_STABLE_BIT))
        ),
        "gas_index": first.bitwiseAND(F.lit(0x0F)),
        "meas_index": _bytes_to_int(h, 1),
        "adc_p": _bytes_to_int(h, 2, 3),
        "adc_t": _bytes_to_int(h, 5, 3),
        "adc_h": _bytes_to_int(h, 8, 2),
        "adc_g": _bytes_to_int(h, 15) * 4 + F.shiftright(last, 6),
        "gas_range": last.bitwiseAND(F.lit(0x0F)),
    })


# Where each coefficient lies in the 42 calibration bytes, as
# (most significant byte, least significant byte or None, signed).
COEFFICIENTS = {
    "par_t1": (32, 31, False),
    "par_t2": (1, 0, False),
    "par_t3": (2, None, True),
    "par_p1": (11, 10, True),
    "par_p2": (13, 12, False),
    "par_p3": (14, None, True),
    "par_p4": (15, None, True),
    "par_p5": (5, 4, True),
    "par_p6": (7, 6, True),
    "par_p7": (8, None, True),
    "par_p8": (9, None, True),
    "par_p9": (19, 18, True),
    "par_p10": (20, None, True),
    "par_p11": (21, None, True),
    "par_h2": (26, None, True),
    "par_h3": (28, None, False),
    "par_h4": (27, None, True),
    "par_h6": (29, None, False),
    "par_g1": (35, None, True),
    "par_g2": (34, 33, True),
    "par_g3": (36, None, True),
    "res_heat_val": (37, None, True),
}


def decode_calibration(df: DataFrame, col: str = "coeff") -> DataFrame:
    """The coefficients packed in a 42-byte block; other lengths give NULLs."""
    h = F.when(F.length(col) == CALIBRATION_BYTES, F.hex(col))
    out = {}
    for name, (msb, lsb, signed) in COEFFICIENTS.items():
        value, bits = _bytes_to_int(h, msb), 8
        if lsb is not None:
            value, bits = value * 256 + _bytes_to_int(h, lsb), 16
        out[name] = _signed(value, bits) if signed else value
    # Two 12-bit values share byte 24: one takes its low half, one its high half.
    shared = _bytes_to_int(h, 24)
    out["par_h1"] = _bytes_to_int(h, 25) * 16 + shared.bitwiseAND(F.lit(0x0F))
    out["par_h5"] = _bytes_to_int(h, 23) * 16 + F.shiftright(shared, 4)
    out["res_heat_range"] = F.shiftright(_bytes_to_int(h, 39), 4).bitwiseAND(F.lit(0x03))
    out["range_sw_err"] = F.shiftright(_signed(_bytes_to_int(h, 41), 8), 4)
    return df.withColumns(out)


Calibration = Mapping[str, Column] | Column


def _polynomial(x: Column, *coefficients: Column) -> Column:
    """c0 + c1*x + c2*x^2 + ..., by Horner's rule."""
    total = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        total = total * x + c
    return total


def _real(c: Column, power_of_two: int = 0) -> Column:
    """``c`` as a double divided by a power of two."""
    return c.cast("double") * F.lit(2.0 ** -power_of_two)


def comp_temperature(adc_t: Column, calib: Calibration) -> Column:
    """Compensated temperature, degrees Celsius."""
    delta = adc_t.cast("double") - _real(calib["par_t1"], -8)
    return _polynomial(
        delta, F.lit(0.0), _real(calib["par_t2"], 30), _real(calib["par_t3"], 48)
    )


def comp_pressure(adc_p: Column, temperature: Column, calib: Calibration) -> Column:
    """Compensated pressure in Pa: a cubic in the raw count whose coefficients
    are polynomials in temperature."""
    t = temperature.cast("double")
    offset = _polynomial(
        t, _real(calib["par_p1"], -3), _real(calib["par_p2"], 6),
        _real(calib["par_p3"], 8), _real(calib["par_p4"], 15),
    )
    sensitivity = _polynomial(
        t, _real(calib["par_p5"] - 16384, 20), _real(calib["par_p6"] - 16384, 29),
        _real(calib["par_p7"], 32), _real(calib["par_p8"], 37),
    )
    square = _polynomial(t, _real(calib["par_p9"], 48), _real(calib["par_p10"], 48))
    return _polynomial(
        adc_p.cast("double"), offset, sensitivity, square, _real(calib["par_p11"], 65)
    )


def comp_humidity(adc_h: Column, temperature: Column, calib: Calibration) -> Column:
    """Compensated relative humidity in percent; not clamped to 0-100."""
    tc = temperature.cast("double") * 5120.0 - 76800.0
    offset = adc_h.cast("double") - (
        _real(calib["par_h1"], -6) + _real(calib["par_h2"], 14) * tc
    )
    k1, k2 = _real(calib["par_h4"], 26), _real(calib["par_h3"], 26)
    sensed = offset * _real(calib["par_h5"], 16) * _polynomial(tc, F.lit(1.0), k1, k1 * k2)
    return sensed - _real(calib["par_h6"], 19) * sensed * sensed


def gas_resistance(adc_g: Column, gas_range: Column) -> Column:
    """Gas resistance in ohm."""
    scale = F.call_function("shiftright", F.lit(262144), gas_range.cast("int"))
    return scale.cast("double") * 1e6 / (4096 + 3 * (adc_g.cast("long") - 512)).cast("double")


RMOX_MIN, RMOX_MAX = 1e2, 1e12


def rmox_array(adcs: Column, config0: Column, lr: Column, er: Column) -> Column:
    """Sensing-layer resistances of an array of raw counts, within the limits."""
    def one(adc: Column) -> Column:
        between = config0.cast("double") * 1e3 * (adc - lr) / (er - adc)
        return (
            F.when(adc <= lr, F.lit(RMOX_MIN))
            .when(adc >= er, F.lit(RMOX_MAX))
            .otherwise(F.least(F.greatest(between, F.lit(RMOX_MIN)), F.lit(RMOX_MAX)))
        )

    return F.transform(adcs, one)


_FULL_SCALE = 0x3FFF


def _ambient(df: DataFrame, humidity_raw: Column, temperature_raw: Column) -> DataFrame:
    return df.withColumns({
        "humidity": humidity_raw * 100.0 / _FULL_SCALE,
        "temperature": temperature_raw * 165.0 / _FULL_SCALE - 40.0,
    })


def ambient_hs3(df: DataFrame, col: str = "frame") -> DataFrame:
    """Four-byte ambient frames; stale ones (bit 0 of the last byte) are dropped."""
    h = F.hex(col)
    raw_h = _bytes_to_int(h, 0, 2).bitwiseAND(F.lit(_FULL_SCALE))
    raw_t = F.shiftright(_bytes_to_int(h, 2, 2), 2)
    fresh = _bytes_to_int(h, 3).bitwiseAND(F.lit(1)) == 0
    return _ambient(df.where((F.length(col) == 4) & fresh), raw_h, raw_t)


CRC_POLYNOMIAL, CRC_START = 0x1D, 0xFF


def _crc_of_byte(byte: int) -> int:
    for _ in range(8):
        byte = (byte << 1) ^ (CRC_POLYNOMIAL if byte & 0x80 else 0)
        byte &= 0xFF
    return byte


def crc8(hexed: Column, n_bytes: int) -> Column:
    """CRC-8 (MSB first) of the first ``n_bytes`` of a hex string.

    The remainder of every byte value is worked out from the polynomial once and
    becomes a constant array; each row then does one lookup per byte.
    """
    table = F.lit([_crc_of_byte(b) for b in range(256)])
    crc = F.lit(CRC_START)
    for i in range(n_bytes):
        crc = F.get(table, crc.bitwiseXOR(_bytes_to_int(hexed, i)))
    return crc


def ambient_hs4(df: DataFrame, col: str = "frame") -> DataFrame:
    """Five-byte ambient frames; those whose checksum is wrong are dropped."""
    h = F.hex(col)
    raw_h = _bytes_to_int(h, 0, 2).bitwiseAND(F.lit(_FULL_SCALE))
    raw_t = _bytes_to_int(h, 2, 2).bitwiseAND(F.lit(_FULL_SCALE))
    good = crc8(h, 4) == _bytes_to_int(h, 4)
    return _ambient(df.where((F.length(col) == 5) & good), raw_h, raw_t)


# Factors between the units in use.
NS_TO_S, S_TO_MS, OHM_TO_KOHM = 1e-9, 1e3, 1e-3
CENTI_DEGREE, MILLI_PERCENT = 1e-2, 1e-3


def scale_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Multiply columns by unit factors.

    A factor of 1/n on an integer column is an integer division (a clock in
    whole seconds stays whole), a factor n a multiplication of the same type.
    """
    out = {}
    integral = {f.name for f in df.schema.fields if f.dataType.typeName() in
                ("byte", "short", "integer", "long")}
    for name, factor in factors.items():
        c = F.col(name)
        if name in integral and factor < 1:
            out[name] = F.call_function("div", c.cast("long"), F.lit(round(1 / factor)))
        elif name in integral:
            out[name] = c.cast("long") * F.lit(round(factor))
        elif factor < 1:
            out[name] = c.cast("double") / F.lit(float(round(1 / factor)))
        else:
            out[name] = c.cast("double") * F.lit(float(factor))
    return df.withColumns(out)
