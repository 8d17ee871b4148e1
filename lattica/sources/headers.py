"""Headers of raw data: the public XML schema of raw-data files, as columns, and back."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.workers import reachable

NAMESPACE = "http://www.ismrm.org/ISMRMRD"

_XYZ = T.StructType([T.StructField(n, T.DoubleType()) for n in "zyx"])
_SPACES = ("encoding_fov", "encoding_matrix", "recon_fov", "recon_matrix")
_NAMES = ("sequence_type", "trajectory_type", "datetime", "patient_name", "measurement_id", "protocol_name", "patient_position", "vendor", "model")
SCHEMA = T.StructType(
    [T.StructField("lamor_frequency_proton", T.DoubleType()), T.StructField("echo_train_length", T.IntegerType())]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("tr", "te", "ti", "fa", "echo_spacing")]
    + [T.StructField(n, _XYZ) for n in _SPACES]
    + [T.StructField(n, T.StringType()) for n in _NAMES]
    + [T.StructField("misc", T.MapType(T.StringType(), T.StringType()))]
)
#: Lists of sequence parameters: name in the file, column, factor to s or rad.
_LISTS = (("TR", "tr", 1e-3), ("TE", "te", 1e-3), ("TI", "ti", 1e-3), ("flipAngle_deg", "fa", math.pi / 180), ("echo_spacing", "echo_spacing", 1e-3))
#: Texts: path in the file, column.
_TEXTS = (
    ("sequenceParameters/sequence_type", "sequence_type"), ("subjectInformation/patientName", "patient_name"), ("measurementInformation/measurementID", "measurement_id"),
    ("measurementInformation/protocolName", "protocol_name"), ("measurementInformation/patientPosition", "patient_position"),
    ("acquisitionSystemInformation/systemVendor", "vendor"), ("acquisitionSystemInformation/systemModel", "model"),
)


def parse(xml: str, encoding: int = 0) -> dict:
    """One header as values of SCHEMA's columns; all leaves are in `misc` by path."""
    root = ET.fromstring(xml)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    spaces = root.findall("encoding")
    if not 0 <= encoding < len(spaces):
        raise ValueError(f"encoding {encoding} of {len(spaces)}")
    own, out = spaces[encoding], dict.fromkeys(SCHEMA.names)
    text = lambda e, path: None if (v := e.findtext(path)) is None else v.strip()
    out["lamor_frequency_proton"] = float(text(root, "experimentalConditions/H1resonanceFrequency_Hz"))
    for name, column, factor in _LISTS:
        out[column] = [float(e.text) * factor for e in root.findall(f"sequenceParameters/{name}")]
    for path, column in _TEXTS:
        out[column] = text(root, path)
    for name, column in (("encodedSpace", "encoding"), ("reconSpace", "recon")):
        for part, kind, factor in (("fieldOfView_mm", "fov", 1e-3), ("matrixSize", "matrix", 1)):
            at = own.find(f"{name}/{part}")
            if at is not None:
                out[f"{column}_{kind}"] = {n: float(at.findtext(n)) * factor for n in "zyx"}
    length = text(own, "echoTrainLength")
    out["echo_train_length"] = None if length is None else int(length)
    out["trajectory_type"] = text(own, "trajectory")
    # Time and date of the series, else of the study; no time is midnight, no date is none.
    time = text(root, "measurementInformation/seriesTime") or text(root, "studyInformation/studyTime") or "00:00:00"
    date = text(root, "measurementInformation/seriesDate") or text(root, "studyInformation/studyDate")
    out["datetime"] = f"{date} {time}" if date else None
    leaves: dict[str, list[str]] = {}

    def walk(e, path):
        if len(e):
            for c in e:
                walk(c, [*path, c.tag])
        elif e.text and e.text.strip():
            leaves.setdefault("/".join(path), []).append(e.text.strip())

    walk(root, [])
    out["misc"] = {k: "\\".join(v) for k, v in leaves.items()}
    return out


def headers(files: DataFrame, xml: str = "xml", encoding: int = 0, defaults: dict | None = None, overwrite: dict | None = None) -> DataFrame:
    """Rows with the columns of SCHEMA instead of the text; defaults stand in for what a header lacks,
    and overwrite for what it says."""
    reachable(files.sparkSession)
    kept = [f for f in files.schema if f.name != xml]
    schema = T.StructType([*kept, *SCHEMA])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                found = parse(r.pop(xml), encoding)
                for k, v in (defaults or {}).items():
                    if found[k] in (None, []):
                        found[k] = v
                rows.append(r | found | (overwrite or {}))
            yield pd.DataFrame(rows, columns=schema.names).astype(object)

    return files.mapInPandas(run, schema)


def to_xml(h: dict) -> str:
    """The text of a header given as values of SCHEMA's columns."""
    root = ET.Element("ismrmrdHeader", xmlns=NAMESPACE)

    def put(at, path, value):
        if value is not None:
            for name in path.split("/")[:-1]:
                at = at.find(name) if at.find(name) is not None else ET.SubElement(at, name)
            ET.SubElement(at, path.split("/")[-1]).text = str(value)

    if h.get("datetime"):
        date, time = h["datetime"].split(" ")
        put(root, "measurementInformation/seriesDate", date)
        put(root, "measurementInformation/seriesTime", time)
    for path, column in _TEXTS:
        if not path.startswith("sequence"):
            put(root, path, h.get(column))
    put(root, "experimentalConditions/H1resonanceFrequency_Hz", int(h["lamor_frequency_proton"]))
    own = ET.SubElement(root, "encoding")
    for name, column in (("encodedSpace", "encoding"), ("reconSpace", "recon")):
        for n in "xyz":
            if h.get(f"{column}_matrix"):
                put(own, f"{name}/matrixSize/{n}", int(h[f"{column}_matrix"][n]))
        for n in "xyz":
            if h.get(f"{column}_fov"):
                put(own, f"{name}/fieldOfView_mm/{n}", f"{h[f'{column}_fov'][n] * 1000:.10g}")
    put(own, "trajectory", h.get("trajectory_type") or "other")
    put(own, "echoTrainLength", h.get("echo_train_length"))
    for name, column, factor in _LISTS:
        for v in h.get(column) or []:
            part = root.find("sequenceParameters")
            part = ET.SubElement(root, "sequenceParameters") if part is None else part
            ET.SubElement(part, name).text = f"{v / factor:.10g}"
    put(root, "sequenceParameters/sequence_type", h.get("sequence_type"))
    return ET.tostring(root, encoding="unicode")
