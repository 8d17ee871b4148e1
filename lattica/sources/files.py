"""Image files: DICOM in and out, NIfTI in and out.

Files are read with Spark's binary source and decoded on the executors, one file a row; files are made by
the task that holds the image and written in two phases (`rawdata.write_files`): all of them or none.
One image is one task's, whatever the number of images. Both formats follow their public layouts.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.scalar import deg_to_rad, mm_to_m, ms_to_s
from lattica.sources.acquisitions import natural_key
from lattica.sources.rawdata import write_files
from lattica.workers import reachable

EXPLICIT, IMPLICIT = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2"
#: Fixed values of the DICOM standard: value representations with a four-byte length.
LONG_VR = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
#: Fixed values of the DICOM standard: numbers of the attributes used here.
TAGS = {
    "NumberOfFrames": "00280008", "MRAcquisitionType": "00180023", "PixelSpacing": "00280030", "SliceThickness": "00180050",
    "FlipAngle": "00181314", "InversionTime": "00180082", "RepetitionTime": "00180080", "EchoTime": "00180081", "EffectiveEchoTime": "00189082",
    "ImageOrientationPatient": "00200037", "ImagePositionPatient": "00200032", "Rows": "00280010", "Columns": "00280011",
    "RescaleSlope": "00281053", "RescaleIntercept": "00281052", "BitsAllocated": "00280100", "PixelRepresentation": "00280103",
    "TemporalPositionIndex": "00209128", "InStackPositionNumber": "00209057", "NominalCardiacTriggerDelayTime": "00209153",
    "FrameReferenceDateTime": "00189151", "PixelData": "7FE00010",
}
#: Representations of these attributes where the file does not say them.
_VR = {"00280008": "IS", "00180023": "CS", "00280010": "US", "00280011": "US", "00280100": "US", "00280103": "US", "00209128": "UL", "00209057": "UL", "00209153": "FD", "00189082": "FD", "00189151": "DT", "7FE00010": "OW"}
_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
NIL = 0xFFFFFFFF


def _elements(raw: bytes, at: int, end: int, explicit: bool):
    """(tag, representation, value bytes) of all elements, those in sequences included, in file order."""
    while at + 8 <= end:
        group, element = struct.unpack_from("<HH", raw, at)
        tag, at = f"{group:04X}{element:04X}", at + 4
        if group == 0xFFFE:  # items and their ends: go on inside
            at += 4
            continue
        if explicit or group == 2:
            vr = raw[at : at + 2].decode("latin-1")
            if vr in LONG_VR:
                size, at = struct.unpack_from("<I", raw, at + 4)[0], at + 8
            else:
                size, at = struct.unpack_from("<H", raw, at + 2)[0], at + 4
        else:
            size, at = struct.unpack_from("<I", raw, at)[0], at + 4
            vr = _VR.get(tag, "SQ" if size == NIL else "DS")
        if vr == "SQ" or size == NIL and tag != TAGS["PixelData"]:
            continue  # the items follow
        if size == NIL:
            raise ValueError("compressed pixel data cannot be decoded")
        yield tag, vr, raw[at : at + size]
        at += size


def _text(vr: str, value: bytes) -> list[str]:
    if vr in _NUMBERS:
        kind = _NUMBERS[vr]
        return [repr(v) for v in struct.unpack(f"<{len(value) // struct.calcsize(kind)}{kind}", value)]
    if vr in LONG_VR - {"UC", "UR", "UT"}:
        return []
    return [v.strip(" \0") for v in value.decode("latin-1").split("\\")]


def parse_dicom(raw: bytes) -> list[tuple[str, list[str], bytes | None]]:
    """(tag, values as text, pixel bytes) of a file."""
    at = 132 if raw[128:132] == b"DICM" else 0
    syntax, rest = IMPLICIT, at
    if at:  # file information: explicit, up to its group's length
        length = struct.unpack_from("<I", raw, at + 8)[0]
        rest = at + 12 + length
        syntax = next((v.decode().strip(" \0") for t, _, v in _elements(raw, at, rest, True) if t == "00020010"), IMPLICIT)
        if syntax not in (EXPLICIT, IMPLICIT):
            raise ValueError(f"transfer syntax {syntax} cannot be decoded")
    pixel = TAGS["PixelData"]
    return [(t, _text(vr, v), v if t == pixel else None) for t, vr, v in _elements(raw, rest, len(raw), syntax == EXPLICIT)]


def read_dicom_items(spark: SparkSession, path: str, suffix: str | None = "dcm") -> DataFrame:
    """(path, file_order, position, tag, value, pixels): every element of every file, in order. Files are
    ordered by the last number in their names, then by name."""
    reachable(spark)
    source = spark.read.format("binaryFile")
    files = (source.option("pathGlobFilter", f"*.{suffix}") if suffix else source).load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        from lattica.sources import files as own

        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content):
                rows = own.parse_dicom(bytes(raw))
                yield pd.DataFrame({"path": p, "position": range(len(rows)), "tag": [t for t, _, _ in rows], "value": [v for _, v, _ in rows], "pixels": [b for _, _, b in rows]})

    items = files.mapInPandas(run, "path string, position int, tag string, value array<string>, pixels binary")
    name = F.element_at(F.split("path", "/"), -1)
    order = files.select("path").withColumn("file_order", F.row_number().over(Window.orderBy(natural_key(name), "path")) - 1)  # a row a file
    return items.join(order, "path").select("path", "file_order", "position", "tag", "value", "pixels")


def get_items(items: DataFrame, name: str, kind: str = "double") -> DataFrame:
    """(path, file_order, position, values) of one attribute, by name or number, in file order."""
    tag = TAGS.get(name, name).upper()
    return items.where((F.col("tag") == tag) & (F.size("value") > 0)).select("path", "file_order", "position", F.col("value").cast(f"array<{kind}>").alias("values"))


def dicom_headers(items: DataFrame) -> DataFrame:
    """One row a file: sizes, times in s, angles in rad, resolution and position of the center in m, the
    directions of slice, phase and readout (z, y, x each), rescaling, frames; lists have a value a frame."""
    def listed(name, kind="double"):
        own = F.when(F.col("tag") == TAGS[name], F.struct("position", F.col("value").cast(f"array<{kind}>").alias("v")))
        return F.transform(F.array_sort(F.collect_list(own)), lambda e: e["v"]).alias(name)

    names = [n for n in TAGS if n not in ("PixelData", "MRAcquisitionType", "FrameReferenceDateTime")]
    wide = items.groupBy("path", "file_order").agg(*(listed(n) for n in names), listed("MRAcquisitionType", "string"))
    one = lambda n, k=0: F.get(F.get(n, F.lit(0)), F.lit(k))
    flat = lambda n: F.flatten(n)
    frames = F.coalesce(one("NumberOfFrames").cast("int"), F.lit(1))
    is_3d = (frames > 1) & F.coalesce(one("MRAcquisitionType") == "3D", F.lit(False))
    echo = F.when(F.size("EchoTime") > 0, flat("EchoTime")).otherwise(flat("EffectiveEchoTime"))
    per = lambda c: F.when(is_3d, F.slice(c, 1, 1)).otherwise(c)
    head = wide.select(
        "path", "file_order", frames.alias("frames"), is_3d.alias("is_3d"), one("Rows").cast("int").alias("rows"), one("Columns").cast("int").alias("columns"),
        mm_to_m(one("SliceThickness")).alias("resolution_z"), mm_to_m(one("PixelSpacing", 1)).alias("resolution_y"), mm_to_m(one("PixelSpacing", 0)).alias("resolution_x"),
        F.transform(per(echo), ms_to_s).alias("te"), F.transform(per(flat("InversionTime")), ms_to_s).alias("ti"),
        F.transform(per(flat("RepetitionTime")), ms_to_s).alias("tr"), F.transform(per(flat("FlipAngle")), deg_to_rad).alias("fa"),
        F.transform(flat("NominalCardiacTriggerDelayTime"), ms_to_s).alias("trigger_delay"),
        F.transform(flat("TemporalPositionIndex"), lambda v: (v - 1).cast("int")).alias("phase"), F.transform(flat("InStackPositionNumber"), lambda v: (v - 1).cast("int")).alias("slice"),
        *(one("ImageOrientationPatient", 2 - k).alias(f"phase_{n}") for k, n in enumerate("zyx")), *(one("ImageOrientationPatient", 5 - k).alias(f"readout_{n}") for k, n in enumerate("zyx")),
        "ImagePositionPatient", one("BitsAllocated").cast("int").alias("bits"), one("PixelRepresentation").cast("int").alias("signed"), flat("RescaleSlope").alias("slope"), flat("RescaleIntercept").alias("intercept"),
    )
    a, b = {n: F.col(f"readout_{n}") for n in "zyx"}, {n: F.col(f"phase_{n}") for n in "zyx"}
    cross = {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}
    head = head.withColumns({f"slice_{n}": c for n, c in cross.items()})
    # The corner of the first pixel, moved by half the field of view; in a volume each frame by its distance.
    def center(k, n):
        moved = F.col(f"phase_{n}") * F.col("resolution_y") * F.col("columns") / 2 + F.col(f"readout_{n}") * F.col("resolution_x") * F.col("rows") / 2
        step = F.when(F.col("is_3d"), F.col(f"slice_{n}") * F.col("resolution_z")).otherwise(0.0)
        return F.transform("ImagePositionPatient", lambda p, j: mm_to_m(F.get(p, F.lit(2 - k))) + moved - step * (j - F.col("frames") / 2))

    return head.withColumns({f"position_{n}": center(k, n) for k, n in enumerate("zyx")}).drop("ImagePositionPatient")


def dicom_images(items: DataFrame) -> DataFrame:
    """(other, frame, y, x, value): pixels of all files with their rescaling. Frames of a volume are its
    slices. Rows of the file are the axis x, columns the axis y. Files of different sizes raise an error."""
    head = dicom_headers(items)
    sizes = head.select("rows", "columns", "frames").distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError("only files with data of the same shape can be stacked")
    reachable(items.sparkSession)
    pixels = items.where(F.col("tag") == TAGS["PixelData"]).select("path", "pixels")
    rows = head.select("path", "file_order", "rows", "columns", "frames", "bits", "signed", "slope", "intercept").join(pixels, "path")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                kind = np.dtype(f"<{'i' if r.signed == 1 else 'u'}{int(r.bits) // 8}")
                data = np.frombuffer(r.pixels, kind, int(r.frames) * int(r.rows) * int(r.columns)).reshape(int(r.frames), int(r.rows), int(r.columns)).astype(float)
                scale = [np.array(v if v is not None and len(v) else [d], float).reshape(-1, 1, 1) for v, d in ((r.slope, 1.0), (r.intercept, 0.0))]
                data = data * scale[0] + scale[1]
                f, x, y = np.indices(data.shape).reshape(3, -1).astype("int32")
                yield pd.DataFrame({"other": np.int32(r.file_order), "frame": f, "y": y, "x": x, "value": data.ravel()})

    return rows.mapInPandas(run, "other int, frame int, y int, x int, value double")


def _element(tag: str, vr: str, value) -> bytes:
    if vr in _NUMBERS:
        raw = struct.pack("<" + _NUMBERS[vr], value)
    elif vr in ("OB", "OW", "SQ"):
        raw = value
    else:
        raw = "\\".join(map(str, value if isinstance(value, (list, tuple)) else [value])).encode()
        raw += (b"\0" if vr == "UI" else b" ") * (len(raw) % 2)
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode()
    return head + (struct.pack("<HI", 0, len(raw)) if vr in LONG_VR else struct.pack("<H", len(raw))) + raw


def _items(*elements: bytes) -> bytes:
    """A sequence of one item."""
    raw = b"".join(elements)
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(raw)) + raw


def dicom_bytes(volume: np.ndarray, head: dict, uid: str) -> bytes:
    """A multi-frame file of magnitudes (frame, y, x), scaled to 16 bits if head["normalize"]. head: te, ti,
    tr (s), fa (rad), resolution and position (z, y, x in m), directions (slice, phase, readout)."""
    volume = np.abs(np.asarray(volume))
    if head.get("normalize", True) and volume.max() > 0:
        volume = volume / volume.max() * 65535
    slope, intercept = head.get("slope", 1.0), head.get("intercept", 0.0)
    stored = np.clip(np.rint((volume - intercept) / slope), 0, 65535).astype("<u2").transpose(0, 2, 1)  # x is the rows' axis
    frames, nx, ny = stored.shape
    res, position = np.array(head["resolution"], float), np.array(head.get("position", (0, 0, 0)), float)
    slice_, phase, readout = (np.array(v, float) for v in head.get("directions", np.eye(3)))
    text = lambda v: [f"{a:.10g}" for a in v]
    kind = "3D" if head.get("is_3d", frames > 1) else "2D"
    groups = b""
    for f in range(frames):
        corner = position - readout * res[2] * nx / 2 - phase * res[1] * ny / 2 + (slice_ * res[0] * (f - frames / 2) if kind == "3D" else 0)
        own = [
            _element("00209113", "SQ", _items(_element(TAGS["ImagePositionPatient"], "DS", text(corner[::-1] * 1000)))),
            _element("00209116", "SQ", _items(_element(TAGS["ImageOrientationPatient"], "DS", text([*phase[::-1], *readout[::-1]])))),
            _element("00289110", "SQ", _items(_element(TAGS["SliceThickness"], "DS", text([res[0] * 1000])), _element(TAGS["PixelSpacing"], "DS", text([res[2] * 1000, res[1] * 1000])))),
            _element("00289145", "SQ", _items(_element(TAGS["RescaleIntercept"], "DS", text([intercept])), _element(TAGS["RescaleSlope"], "DS", text([slope])))),
        ]
        if "te" in head:
            own.append(_element("00189114", "SQ", _items(_element(TAGS["EffectiveEchoTime"], "FD", head["te"] * 1000))))
        timing = [_element(TAGS[n], "DS", text([head[k] * s])) for n, k, s in (("RepetitionTime", "tr", 1000), ("InversionTime", "ti", 1000), ("FlipAngle", "fa", 180 / np.pi)) if k in head]
        if timing:
            own.append(_element("00189112", "SQ", _items(*timing)))
        groups += _items(*own)
    body = [
        _element("00080016", "UI", "1.2.840.10008.5.1.4.1.1.4.1"), _element("00080018", "UI", uid), _element("00080060", "CS", "MR"), _element("00080102", "SH", "none"),
        _element("00100010", "PN", "Unknown"), _element("00100020", "LO", "Unknown"), _element(TAGS["MRAcquisitionType"], "CS", kind), _element("00185100", "CS", "HFS"),
        _element("00280002", "US", 1), _element("00280004", "CS", "MONOCHROME2"), _element(TAGS["NumberOfFrames"], "IS", frames), _element(TAGS["Rows"], "US", nx), _element(TAGS["Columns"], "US", ny),
        _element(TAGS["BitsAllocated"], "US", 16), _element("00280101", "US", 16), _element("00280102", "US", 15), _element(TAGS["PixelRepresentation"], "US", 0),
        _element("52009230", "SQ", groups), _element(TAGS["PixelData"], "OW", stored.tobytes() + b"\0" * (stored.nbytes % 2)),
    ]
    meta = b"".join((_element("00020002", "UI", "1.2.840.10008.5.1.4.1.1.4.1"), _element("00020003", "UI", uid), _element("00020010", "UI", EXPLICIT)))
    return b"\0" * 128 + b"DICM" + _element("00020000", "UL", len(meta)) + meta + b"".join(body)


def _volume(pdf, axes: list[str]) -> np.ndarray:
    at = [pdf[n].to_numpy() for n in axes]
    out = np.zeros([a.max() + 1 for a in at], complex)
    out[tuple(at)] = pdf.re.to_numpy() + 1j * (pdf.im.to_numpy() if "im" in pdf else 0)
    return out


def _put(files: DataFrame, df: DataFrame, folder: str, by: str, suffix: str) -> DataFrame:
    """Write the files; (by, path) of each."""
    write_files(files, folder)
    path = F.concat(F.lit(f"{folder.rstrip('/')}/im_"), F.col(by).cast("string"), F.lit(f".{suffix}"))
    return df.select(F.col(by).cast("int").alias(by)).distinct().withColumn("path", path)


def write_dicom_folder(df: DataFrame, folder: str, head: dict, by: str = "other") -> DataFrame:
    """One multi-frame file for each `by` of rows (by, z, y, x, re [, im]); returns (by, path)."""
    reachable(df.sparkSession)

    def run(pdf):
        import uuid

        import pandas as pd

        k = int(pdf[by].iloc[0])
        uid = f"2.25.{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{k}').int}"
        return pd.DataFrame({by: [k], "name": [f"im_{k}.dcm"], "content": [dicom_bytes(_volume(pdf, ["z", "y", "x"]), head, uid)]})

    return _put(df.groupBy(by).applyInPandas(run, f"{by} int, name string, content binary"), df, folder, by, "dcm")


def nifti_bytes(data: np.ndarray, resolution=(1.0, 1.0, 1.0), affine=None, magnitude_only: bool = False, description: str = "") -> bytes:
    """data: (x, y, z, 1, other, more, coils). Magnitudes make a NIfTI-1 file of float32, complex values a
    NIfTI-2 file of complex64. resolution: z, y, x; affine: 4 x 4 in x, y, z."""
    affine = np.eye(4) if affine is None else np.asarray(affine, float)
    data = np.abs(data).astype("<f4") if magnitude_only else np.asarray(data).astype("<c8")
    dim = [data.ndim, *data.shape] + [1] * (7 - data.ndim)
    pixdim = [1.0, *resolution[::-1], *([1.0] * 4)]
    text = description.encode()[:79]
    code, bits = (16, 32) if magnitude_only else (32, 64)
    rows = [v for r in affine[:3] for v in r]
    if magnitude_only:
        head = struct.pack("<i10s18sihcb8h3f4h8f3fhbb4f2i80s24s2h6f12f16s4s", 348, b"", b"", 0, 0, b"r", 0, *dim, 0, 0, 0, 0, code, bits, 0, *pixdim, 352.0, 1.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, text, b"", 0, 2, 0, 0, 0, *affine[:3, 3], *rows, b"", b"n+1\0")
        return head + b"\0" * 4 + data.tobytes(order="F")
    head = struct.pack("<i8s2h8q3d8dq6d2q80s24s2i6d12d3i16sb15s", 540, b"n+2\0\r\n\x1a\n", code, bits, *dim, 0, 0, 0, *pixdim, 544, 1.0, 0.0, 0, 0, 0, 0, 0, 0, text, b"", 0, 2, 0, 0, 0, *affine[:3, 3], *rows, 0, 0, 0, b"", 0, b"")
    return head + b"\0" * 4 + data.tobytes(order="F")


def parse_nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(data, affine) of a file with float32 or complex64 values."""
    second = struct.unpack_from("<i", raw)[0] == 540
    if second:
        code, dim, offset = struct.unpack_from("<h", raw, 12)[0], struct.unpack_from("<8q", raw, 16), struct.unpack_from("<q", raw, 168)[0]
        affine = np.array(struct.unpack_from("<12d", raw, 400)).reshape(3, 4)
    else:
        code, dim, offset = struct.unpack_from("<h", raw, 70)[0], struct.unpack_from("<8h", raw, 40), int(struct.unpack_from("<f", raw, 108)[0])
        affine = np.array(struct.unpack_from("<12f", raw, 280)).reshape(3, 4)
    kind = {16: "<f4", 32: "<c8"}[code]
    shape = dim[1 : dim[0] + 1]
    data = np.frombuffer(raw, kind, int(np.prod(shape)), offset).reshape(shape, order="F")
    return data, np.vstack([affine, [0, 0, 0, 1]])


def write_nifti_folder(df: DataFrame, folder: str, resolution=(1.0, 1.0, 1.0), position=(0.0, 0.0, 0.0), orientation=None, magnitude_only: bool = False, description: str = "", by: str = "image") -> DataFrame:
    """One file for each `by` of rows (by, other, coil, z, y, x, re, im); returns (by, path).
    orientation: 3 x 3 matrix in z, y, x; position: z, y, x."""
    reachable(df.sparkSession)
    m = np.eye(3) if orientation is None else np.asarray(orientation, float)
    affine = np.vstack([[1.0, 0, 0, 0], np.column_stack([np.asarray(position, float), m])])[::-1, ::-1]

    def run(pdf):
        import pandas as pd

        k = int(pdf[by].iloc[0])
        data = _volume(pdf, ["other", "coil", "z", "y", "x"]).transpose(4, 3, 2, 0, 1)[:, :, :, None, :, None, :]
        return pd.DataFrame({by: [k], "name": [f"im_{k}.nii"], "content": [nifti_bytes(data, resolution, affine, magnitude_only, description)]})

    return _put(df.groupBy(by).applyInPandas(run, f"{by} int, name string, content binary"), df, folder, by, "nii")


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """(path, other, coil, z, y, x, re, im) of all files."""
    reachable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        from lattica.sources import files as own

        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content):
                data, _ = own.parse_nifti(bytes(raw))
                data = data.reshape(*data.shape, *([1] * (7 - data.ndim)))
                x, y, z, _, other, _, coil = np.indices(data.shape).reshape(7, -1).astype("int32")
                flat = data.ravel()
                yield pd.DataFrame({"path": p, "other": other, "coil": coil, "z": z, "y": y, "x": x, "re": flat.real.astype(float), "im": flat.imag.astype(float)})

    return files.mapInPandas(run, "path string, other int, coil int, z int, y int, x int, re double, im double")
