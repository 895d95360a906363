"""CSV cut inside one file against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.sources import csv_ranges, issues_csv


@pytest.fixture
def cut(spark):
    """Files are cut into ranges of so many bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, n, end):
    r = random.Random(seed)
    plain = ["", "a", "x y", 'in"ner', "ünï", "1", 'q"', " ", "\tt"]
    quoted = ["", "a,b", 'say ""hi""', f"two{end}lines", f'{end}""{end}{end},', '""', f"long {'z' * 90}{end}{'y' * 60}", "plain"]
    field = lambda: r.choice(plain) if r.random() < 0.6 else f'"{r.choice(quoted)}"'
    lines = ["id,b,c"]
    for i in range(n):
        width = 3 if r.random() < 0.95 else r.choice([2, 4])
        lines.append(",".join([str(i), *[field() for _ in range(width - 1)]]))
        if r.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed,end,size", [(1, "\n", 64), (2, "\n", 200), (3, "\r\n", 97), (4, "\n", 10**6), (5, "\n", 33)])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, cut, seed, end, size):
    path = tmp_path / "a.csv"
    path.write_bytes(made(seed, 120, end).encode())
    whole = issues_csv.read(spark, str(path)).select("row", "c0", "c1", "c2", F.replace(issues_csv.BAD, F.lit("\r\n"), F.lit("\n")))
    expected = sorted(map(tuple, whole.collect()), key=lambda r: r[0])
    cut(size)
    got = issues_csv.read_ranges(spark, str(path)).select("row", "c0", "c1", "c2", issues_csv.BAD)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected
    assert got.rdd.getNumPartitions() > 3 or size > 10**5


def test_several_files_headers_over_ranges_and_quotes_that_never_end(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('"a\n\nname",b\n1,2\n')
    (tmp_path / "b.csv").write_text('"a\n\nname",b\n3,"x\ny"\n\n4,"never\nends,\n')
    (tmp_path / "c.csv").write_text('"a\n\nname",b\n')
    (tmp_path / "d.csv").write_text('"a\n\nname",b\n5,6')
    cut(3)
    got = sorted(map(tuple, csv_ranges.rows(spark, str(tmp_path)).collect()))
    assert got == [(0, "1,2"), (1, '3,"x\ny"'), (2, '4,"never\nends,'), (3, "5,6")]


def test_other_cuts_in_the_second_scan_are_an_error(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text("a\n" + "1\n" * 200)
    cut(50)
    rows = csv_ranges.rows(spark, str(tmp_path / "a.csv"))
    cut(70)
    with pytest.raises(Exception, match="INGEST_CSV_RANGES_CHANGED"):
        rows.count()


def test_states_of_lines():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        opens, stays = r.random((2, 12)) < 0.5
        for inside in (False, True):
            states = [inside]
            for o, s in zip(opens, stays, strict=True):
                states.append(bool(s if states[-1] else o))
            assert csv_ranges._states(opens, stays, inside).tolist() == states
