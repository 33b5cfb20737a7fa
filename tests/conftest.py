import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from granulith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PARTICLE = dict(image_id=1, particle_id=1, cx=0.0, cy=0.0, diam_px=40.0, diam_nm=400.0, major_px=41.0,
                minor_px=39.5, solidity=0.95, facet_frac=0.8, edge_cut=0.0, touches_edge=False, perim_px=126.0,
                bright=0.0, pattern_probs=[0.7, 0.1, 0.1, 0.1], user_measurable=None, is_solid=False, pattern="",
                excluded=False, unclassified=False, user_solid=False, nm_per_px=10.0, detector="CBS",
                structure=-1.0, classifiable=True)
DDL = ("image_id long, particle_id long, cx double, cy double, diam_px double, diam_nm double, major_px double, "
       "minor_px double, solidity double, facet_frac double, edge_cut double, touches_edge boolean, perim_px double, "
       "bright double, pattern_probs array<double>, user_measurable boolean, is_solid boolean, pattern string, "
       "excluded boolean, unclassified boolean, user_solid boolean, nm_per_px double, detector string, "
       "structure double, classifiable boolean")


@pytest.fixture(scope="session")
def make(spark):
    """make([{...}, ...]): particle rows with the given fields changed, numbered from 1."""
    def build(rows):
        full = [{**PARTICLE, "particle_id": i + 1, **r} for i, r in enumerate(rows)]
        names = [f.split()[0] for f in DDL.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], DDL)
    return build
