"""Records and enumerations of acquisitions and images, as struct types and fixed strings."""

from __future__ import annotations

from enum import Enum, IntFlag

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InterleavingDimension(Enum):
    """Fixed values."""

    PHASE = "phase"
    REPETITION = "repetition"
    CONTRAST = "contrast"
    AVERAGE = "average"
    OTHER = "other"


class MultibandCalibration(Enum):
    """Fixed values."""

    SEPARABLE2_D = "separable2D"
    FULL3_D = "full3D"
    OTHER = "other"


#: Head or feet first; prone, supine, or on the right or left side.
PatientPosition = Enum("PatientPosition", {k: k for k in ("HFP", "HFS", "HFDR", "HFDL", "FFP", "FFS", "FFDR", "FFDL", "OTHER")})


class TrajectoryType(Enum):
    """Fixed values."""

    CARTESIAN = "cartesian"
    EPI = "epi"
    RADIAL = "radial"
    GOLDENANGLE = "goldenangle"
    SPIRAL = "spiral"
    OTHER = "other"


class WaveformInformation(Enum):
    """Fixed values."""

    ECG = "ecg"
    PULSE = "pulse"
    RESPIRATORY = "respiratory"
    TRIGGER = "trigger"
    GRADIENTWAVEFORM = "gradientwaveform"
    OTHER = "other"


class CalibrationMode(Enum):
    """Fixed values."""

    EMBEDDED = "embedded"
    INTERLEAVED = "interleaved"
    SEPARATE = "separate"
    EXTERNAL = "external"
    OTHER = "other"


class TrajType(IntFlag):
    """What is known of a coordinate of a trajectory."""

    SINGLEVALUE = 1
    ONGRID = 2


def known(column: str | Column, kind: type[Enum]) -> Column:
    """The value if it is one of the enumeration's, else its `other`; case does not matter."""
    c = F.col(column) if isinstance(column, str) else column
    values = {str(v.value).lower(): v.value for v in kind}
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(c)), F.lit(values["other"]))


def _struct(kind: T.DataType, names) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


#: Counters of a reading.
ACQ_INDEX = T.StructType(_struct(T.IntegerType(), ("k1", "k2", "average", "slice", "contrast", "phase", "repetition", "set", "segment", *(f"user{k}" for k in range(8)))))
#: Counters of an image: those of a reading without the phase encoding and the segment.
IMAGE_INDEX = T.StructType([f for f in ACQ_INDEX if f.name not in ("k1", "k2", "segment")])
USER_VALUES = T.StructType(_struct(T.DoubleType(), (f"float{k}" for k in range(8))) + _struct(T.IntegerType(), (f"int{k}" for k in range(8))))
PHYSIOLOGY_TIMESTAMPS = T.StructType(_struct(T.DoubleType(), (f"timestamp{k}" for k in range(3))))
LIMITS = T.StructType(_struct(T.IntegerType(), ("min", "max", "center")))


def record(kind: T.StructType, **given) -> Column:
    """A struct of the kind from columns or values; what is not given is 0."""
    if more := set(given) - set(kind.names):
        raise ValueError(f"no such fields: {sorted(more)}")
    value = lambda v: F.lit(0) if v is None else v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(value(given.get(f.name)).cast(f.dataType).alias(f.name) for f in kind))


def image_index(acq: str | Column) -> Column:
    """The image counters of a struct of reading counters."""
    c = F.col(acq) if isinstance(acq, str) else acq
    return F.struct(*(c[n].alias(n) for n in IMAGE_INDEX.names))


def length(limits: str | Column) -> Column:
    c = F.col(limits) if isinstance(limits, str) else limits
    return c["max"] - c["min"] + 1


def reduced(df: DataFrame, by: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row a group of what does not vary in it; a field that varies raises an error."""
    aggs = []
    for f in fields:
        spread = F.max(f) - F.min(f)
        varies = F.coalesce(spread > tolerance, F.lit(False))
        aggs.append(F.when(varies, F.raise_error(F.lit(f"{f} varies within a group"))).otherwise(F.min(f)).alias(f))
    return df.groupBy(*by).agg(*aggs)


def check_bounds(low: float, high: float, kind: str) -> tuple[float, float]:
    """Bounds clipped to the range of an integer type (byte, short, int, long), or as they are."""
    bits = {"byte": 7, "short": 15, "int": 31, "long": 63}.get(kind)
    if bits:
        low, high = max(low, -(1 << bits)), min(high, (1 << bits) - 1)
    if low > high:
        raise ValueError(f"lower bound {low} above {high}")
    return low, high


def summary(value: Column, most: int = 6) -> Column:
    """An array as text: its distinct values if at most `most`, else their range."""
    distinct = F.array_sort(F.array_distinct(F.filter(value, lambda v: v.isNotNull())))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ", ")
    few, first, last = text(distinct), F.element_at(distinct, 1), F.element_at(distinct, -1)
    return F.when(F.size(distinct) == 0, "none").when(F.size(distinct) <= most, few).otherwise(F.concat(F.lit("["), first.cast("string"), F.lit(", ..., "), last.cast("string"), F.lit("]")))


def summarize(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, least, largest) of every column."""
    out = None
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))
        ends = [F.min(c).cast("string"), F.max(c).cast("string")] if plain else [F.lit(None).cast("string")] * 2
        one = df.agg(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("nulls"), ends[0].alias("least"), ends[1].alias("largest"))
        out = one if out is None else out.unionByName(one)
    return out
