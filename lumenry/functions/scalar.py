"""Scalar functions on strings, numbers, ids and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 64 bits: offset basis and prime, which is 2**40 + 0x1B3.
FNV_BASIS, FNV_LOW_PRIME = 14695981039346656037, 0x1B3
_LIMB = 0xFFFFFFFF


def fnv1a_limbs(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as struct<hi, lo> of 32-bit limbs, which never overflow a bigint."""
    data = text.cast("binary")
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.expr("cast(array() as array<int>)"))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("bigint").alias("hi"), F.lit(FNV_BASIS & _LIMB).cast("bigint").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        low = acc["lo"].bitwiseXOR(byte(i))
        product = low * FNV_LOW_PRIME
        high = acc["hi"] * FNV_LOW_PRIME + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(F.lit(_LIMB)).alias("hi"), product.bitwiseAND(F.lit(_LIMB)).alias("lo"))

    return F.aggregate(at, start, step)


def fnv1a_mod(text: Column, modulus: int) -> Column:
    """FNV-1a of a text as an unsigned number, modulo up to 2**31."""
    limbs = fnv1a_limbs(text)
    return F.aggregate(F.array(limbs), F.lit(0).cast("bigint"), lambda _, x: ((x["hi"] % modulus) * ((1 << 32) % modulus) + x["lo"]) % modulus)


def fnv1a_hex(text: Column) -> Column:
    return F.aggregate(F.array(fnv1a_limbs(text)), F.lit(""), lambda _, x: F.concat(F.lpad(F.lower(F.hex(x["hi"])), 8, "0"), F.lpad(F.lower(F.hex(x["lo"])), 8, "0")))


def size_format(n: Column, largest: str = "P") -> Column:
    """Bytes with a unit of 1024 steps, ``largest`` at most, and four decimals."""
    out, units = F.concat(n.cast("string"), F.lit("B")), ("B", "K", "M", "G", "T", "P")
    for k in range(1, units.index(largest) + 1):
        text = F.format_string(f"%.4f{units[k]}", F.bround(n.cast("double") / float(1 << (10 * k)), 4))
        out = F.when(n >= (1 << (10 * k)), text).otherwise(out)
    return out


def trim_to(text: Column, most: int, left: bool = False) -> Column:
    """At most ``most`` bytes from the start, or with ``left`` from the end."""
    data = text.cast("binary")
    cut = F.substring(data, F.octet_length(data) - most + 1, F.lit(most)) if left else F.substring(data, 1, most)
    return F.when(F.octet_length(data) > most, F.decode(cut, "utf-8")).otherwise(text)


def float_equals(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-9


def adjust_kv(text: Column) -> Column:
    """Without trailing back slashes, and with spaces for line ends."""
    return F.replace(F.regexp_replace(text, r"\\+$", ""), F.lit("\n"), F.lit(" "))


def dots_to_underscores(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit("_"))


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters; an empty text is one empty piece."""
    count = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def hex_id(data: Column) -> Column:
    """Lower-case hex of an id, "0" if all its bytes are zero or it is empty."""
    text = F.lower(F.hex(data))
    return F.when(F.rlike(text, F.lit("^0*$")), F.lit("0")).otherwise(text)


def base64_id(data: Column) -> Column:
    return F.base64(data)


def decimal_id(data: Column) -> Column:
    """The last 8 bytes as an unsigned decimal number."""
    text = F.hex(data)
    return F.conv(F.substring(text, -16, 16), 16, 10)


def detect_precision(t: Column) -> Column:
    """The unit of a time by its magnitude."""
    return F.when(t < 10**10, "s").when(t < 10**13, "ms").when(t < 10**16, "u").otherwise("n")


def to_nanoseconds(t: Column, unit: str | None = None) -> Column:
    """A time in n, u, ms, s, m or h, or in the unit its magnitude shows, as nanoseconds."""
    scale = {"n": 1, "u": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
    if unit:
        return t * scale[unit]
    return F.when(t < 10**10, t * scale["s"]).when(t < 10**13, t * scale["ms"]).when(t < 10**16, t * scale["u"]).otherwise(t)


def prometheus_measurement(name: Column, prefix: str = "", default: str = "") -> Column:
    """The first two parts of a metric's name, the prefix put before once; names of one part get the default or themselves."""
    parts = F.split(name, "_")
    base = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(F.lit(default) if default else name)
    return F.when(F.startswith(base, F.lit(prefix)), base).otherwise(F.concat(F.lit(prefix), base)) if prefix else base


def plain_number(value: Column) -> Column:
    """A double without exponent, and without a fraction if it has none."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.12f", value), "0+$", ""), r"\.$", ""))


def days_left(not_after_s: Column, now_s: Column) -> Column:
    return F.floor((not_after_s - now_s) / 86_400).cast("bigint")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def span_status(code: Column) -> Column:
    """Status of a span: 0 and 1 are ok, 2 is error, others and none are info."""
    return F.when(code.isin(0, 1), "ok").when(code == 2, "error").otherwise("info")


def severity(number: Column, fallback: Column | None = None) -> Column:
    """Log status of an OTLP severity number; 0 is unknown, a number out of range gives the fallback."""
    out = F.when(number == 0, "unknown")
    for k, name in enumerate(("trace", "debug", "info", "warn", "error", "fatal")):
        out = out.when(number.between(4 * k + 1, 4 * k + 4), name)
    return out.otherwise(F.lit("unknown") if fallback is None else fallback)


def span_kind(number: Column) -> Column:
    names = ("unspecified", "internal", "server", "client", "producer", "consumer")
    out = F.when(number == 0, names[0])
    for k in range(1, 6):
        out = out.when(number == k, names[k])
    return out.otherwise(names[0])


#: Nanoseconds or bytes of profile units.
TIME_UNITS = {"nanoseconds": 1, "microseconds": 10**3, "milliseconds": 10**6, "seconds": 10**9, "minutes": 60 * 10**9, "hours": 3600 * 10**9}
SIZE_UNITS = {"bytes": 1, "kilobytes": 1 << 10, "megabytes": 1 << 20, "gigabytes": 1 << 30, "terabytes": 1 << 40}
_UNIT_NAMES = {"ns": "nanoseconds", "us": "microseconds", "ms": "milliseconds", "s": "seconds", "b": "bytes", "kb": "kilobytes", "mb": "megabytes", "gb": "gigabytes", "tb": "terabytes"}


def convert_unit(value: Column, unit: str, to: str) -> Column:
    """A quantity in another unit of the same kind."""
    full = lambda u: _UNIT_NAMES.get(u.lower(), u.lower() if u.lower() in TIME_UNITS or u.lower() in SIZE_UNITS else u.lower() + "s")
    for units in (TIME_UNITS, SIZE_UNITS):
        if full(unit) in units and full(to) in units:
            return value.cast("double") * (units[full(unit)] / units[full(to)])
    raise ValueError(f"{unit} and {to} aren't of one kind")


def format_duration(ns: Column, largest: str = "s") -> Column:
    """Nanoseconds with the largest unit that is not over them, ``largest`` at most, two decimals."""
    out, units = F.concat(ns.cast("string"), F.lit("ns")), ("ns", "us", "ms", "s")
    for k in range(1, units.index(largest) + 1):
        out = F.when(ns >= 10 ** (3 * k), F.format_string(f"%.2f{units[k]}", ns / 10 ** (3 * k))).otherwise(out)
    return out


def encrypt(text: Column, phrase: str) -> Column:
    """AES-GCM under the MD5 of a phrase, base64."""
    return F.base64(F.aes_encrypt(text, F.unhex(F.md5(F.lit(phrase))), F.lit("GCM")))


def decrypt(text: Column, phrase: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(text), F.unhex(F.md5(F.lit(phrase))), F.lit("GCM")), "utf-8")


def merge_tags(*maps: Column) -> Column:
    """String maps as one with underscores for dots in keys; the first map that has a key wins."""
    plain = [F.transform_keys(m, lambda k, _: dots_to_underscores(k)) for m in maps]

    def without(own: Column, first: Column) -> Column:
        return F.map_filter(own, lambda k, _: ~F.map_contains_key(first, k))

    out = plain[0]
    for m in plain[1:]:
        out = F.map_concat(out, without(m, out))
    return out


def formatted_time(ts: Column, unit: str) -> Column:
    """A timestamp as a number of s, ms, us or ns, as templates write it."""
    micros = F.unix_micros(ts)
    return {"s": F.floor(micros / 1_000_000), "ms": F.floor(micros / 1000), "us": micros, "ns": micros * 1000}[unit].cast("bigint")


def to_whole(value: Column, how: str = "trunc") -> Column:
    """A double as a whole number: trunc (toward 0), floor or ceil."""
    return {"trunc": F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), "floor": F.floor(value), "ceil": F.ceil(value)}[how].cast("bigint")


def url_encoded(text: Column) -> Column:
    """A text for a query string: a space is "+", and "~" stands for itself, "*" doesn't."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def formatted_date(ts: Column, style: str) -> Column:
    """A time without zone as templates write it: rfc3339, iso8601 or a pattern of Spark's."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss'Z'" if style in ("rfc3339", "iso8601") else style
    return F.date_format(ts, pattern)


def sample_stdev(values: Column) -> Column:
    """Sample deviation of an array of doubles; null for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))


def percentile_of(values: Column, percent: float) -> Column:
    """The percentile (0 to 100) of an array, between its two nearest values; 0 for an empty array."""
    ordered, place = F.array_sort(values), F.lit(percent / 100.0) * (F.size(values) - 1)
    low = F.get(ordered, F.floor(place).cast("int"))
    return F.when(F.size(values) > 0, low + (F.get(ordered, F.ceil(place).cast("int")) - low) * (place - F.floor(place))).otherwise(0.0)
