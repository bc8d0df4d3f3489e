"""Presets of categories to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories by archive.
CATEGORIES = {
    "cs": [
        "cs.AI", "cs.CL", "cs.LG", "cs.CV", "cs.NE", "cs.RO", "cs.AR", "cs.OS", "cs.DC", "cs.SE", "cs.PL", "cs.DS", "cs.CR", "cs.NI",
        "cs.IT", "cs.DB", "cs.DL", "cs.IR", "cs.DM", "cs.GR", "cs.MM", "cs.CG", "cs.HC", "cs.CC", "cs.LO", "cs.ET", "cs.FL", "cs.GT",
        "cs.SC", "cs.SI", "cs.SY", "cs.SD", "cs.CE", "cs.MS", "cs.NA", "cs.PF", "cs.CY", "cs.OH",
    ],
    "eess": [
        "eess.AS", "eess.IV", "eess.SP", "eess.SY",
    ],
    "math": [
        "math.OC", "math.NA", "math.ST", "math.IT", "math.CO", "math.DS",
    ],
    "stat": [
        "stat.ML", "stat.AP", "stat.TH", "stat.CO",
    ],
    "q-bio": [
        "q-bio.BM", "q-bio.CB", "q-bio.GN", "q-bio.MN", "q-bio.NC", "q-bio.OT", "q-bio.PE", "q-bio.QM", "q-bio.SC", "q-bio.TO",
    ],
    "q-fin": [
        "q-fin.CP", "q-fin.ST", "q-fin.TR",
    ],
    "econ": [
        "econ.EM", "econ.TH", "econ.GN",
    ],
    "physics": [
        "physics.data-an", "physics.soc-ph", "physics.comp-ph",
    ],
}
# Presets as categories or whole archives.
PRESETS = {
    "cs-core": ["cs.AI", "cs.CL", "cs.LG", "cs.CV", "cs.NE", "cs.RO"],
    "cs-systems": ["cs.OS", "cs.DC", "cs.SE", "cs.PL", "cs.AR", "cs.DS"],
    "cs-data": ["cs.DB", "cs.IR", "cs.DL", "cs.DM", "cs.IT"],
    "cs-security": ["cs.CR", "cs.NI", "cs.SY"],
    "cs-graphics": ["cs.GR", "cs.MM", "cs.CG", "cs.HC"],
    "cs-all": ["cs"],
    "eess-all": ["eess"],
    "math-relevant": ["math"],
    "stat-relevant": ["stat"],
    "biotech": ["q-bio"],
    "quant-finance": ["q-fin"],
    "ai-applications": ["stat", "q-fin", "econ", "physics"],
    "comprehensive": ["cs", "eess", "math", "stat", "q-bio", "q-fin", "econ", "physics"],
}


def preset(name: str) -> list[str]:
    """Categories of a preset; unknown names raise KeyError."""
    return [c for part in PRESETS[name] for c in CATEGORIES.get(part, [part])]


def preset_table(spark: SparkSession) -> DataFrame:
    """(preset, pos, category), a small constant table."""
    rows = [(p, i, c) for p in PRESETS for i, c in enumerate(preset(p))]
    return spark.createDataFrame(rows, "preset string, pos int, category string")
