"""Session settings from a properties file."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_properties(path: str) -> dict[str, str]:
    """``key=value`` or ``key: value`` lines; # and ! start comments; a backslash at the end continues a line."""
    out, held = {}, ""
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = held + line.strip()
            if not line or line[0] in "#!":
                held = ""
                continue
            if line.endswith("\\"):
                held = line[:-1]
                continue
            held = ""
            at = min((k for k in (line.find("="), line.find(":")) if k >= 0), default=len(line))
            out[line[:at].strip()] = line[at + 1 :].strip()
    return out


def session(properties: dict[str, str], app: str = "treeline") -> SparkSession:
    """The active session, or one with the ``spark.*`` settings; ``spark.master`` defaults to local[*]."""
    own = {k: v for k, v in properties.items() if k.startswith("spark.")}
    found = SparkSession.getActiveSession()
    if found and not own:
        return found
    return SparkSession.builder.appName(app).config(map={"spark.master": "local[*]"} | own).getOrCreate()
