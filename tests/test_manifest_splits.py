"""Files whose digest is taken split by split."""

import gzip
import hashlib
import random

import pytest

from tablewright.errors import SourceError
from tablewright.sources.files import file_manifest, split_digests

MARK = b"\xef\xbb\xbf"
DRAW = random.Random(3)
FILES = {
    "random.parquet": DRAW.randbytes(9000),
    "few.csv": bytes(DRAW.choice(b"\n\n\xef\xbb\xbf") for _ in range(4000)),
    "ends.csv": b"\n" * 2500,
    "marked.csv": MARK + b"a,b\r\n" + b"1,2\r\n" * 400,
    "marked, open.csv": MARK + b"a,b\n" + b"1,2\n" * 400 + b"x",
    "marks.csv": MARK * 700,
    "carriage.csv": b"a\r" * 1500,
    "a b+[1]{x}*.csv": b"ab\n" * 900,
    "k=1/one line.csv": bytes(4000),
    "small.csv": b"a\n1\n",
}


@pytest.fixture(params=["400", "100000"])
def tiny(spark, request):
    """Splits of a few hundred bytes, and no cell above 1000 bytes of a file."""
    names = {
        "spark.sql.files.maxPartitionBytes": request.param,
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.sources.binaryFile.maxLength": "1000",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_large_files_are_digested_without_a_cell_that_holds_them(tiny, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    packed = gzip.compress(DRAW.randbytes(700))  # above whole_bytes, but the text reader would unpack it
    (tmp_path / "packed.csv.gz").write_bytes(packed)
    (tmp_path / "beyond.csv").write_bytes(b"x\n" * 9000)
    got = file_manifest(tiny, str(tmp_path), size_cap=10000, whole_bytes=500)
    wanted = {k.rsplit("/")[-1]: (len(v), hashlib.sha256(v).hexdigest()) for k, v in {**FILES, "packed.csv.gz": packed}.items()}
    wanted["beyond.csv"] = (18000, None)
    assert {r["original_name"]: (r["size_bytes"], r["sha256"]) for r in got.collect()} == wanted
    assert got.count() == len(wanted)


def test_a_task_reads_one_split(tiny, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_bytes(b"1,2\n" * 5000)
    size = min(int(tiny.conf.get("spark.sql.files.maxPartitionBytes")), 20000)
    tracker = tiny.sparkContext.statusTracker()
    tiny.sparkContext.setJobGroup("digest", "splits")
    try:
        assert split_digests(tiny, {f"file:{path}": 20000}) == {f"file:{path}": hashlib.sha256(path.read_bytes()).hexdigest()}
    finally:
        tiny.sparkContext._jsc.clearJobGroup()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("digest") for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) >= 20000 // size and {s.numTasks for s in stages} == {1}


def test_a_file_that_changes_while_it_is_read_is_an_error(tiny, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_bytes(b"1,2\n" * 500)
    with pytest.raises(SourceError, match="2100 bytes"):
        split_digests(tiny, {f"file:{path}": 2100})
