"""Line numbers, early ends and the ordered output, over files in many splits."""

import pytest
from pyspark.sql import functions as F

from lograft.operators import cleaning as C
from lograft.plans import layout as L
from lograft.sources import ordered as O


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def files(tmp_path, bad=(), names=("a.log", "b b.log", "c%20.log", "d.log", "e.log", "f.log")):
    """Files of unlike sizes; ``bad`` are places (file, line) of lines that are no records."""
    lines = {}
    for f, name in enumerate(names):
        own = [f'{{"f":{f},"i":{i},"level":"INFO","msg":"said {i}"}}' if (f, i) not in bad else "no record" for i in range((0, 700, 1, 300, 90, 40)[f])]
        (tmp_path / name).write_text("".join(x + "\n" for x in own))
        lines[f] = own
    return lines


def at(line):
    return tuple(map(int, line.replace(",", ":").split(":")[1:4:2]))


def test_numbers_have_no_gaps(spark, tmp_path, small_splits):
    lines = files(tmp_path)
    df = O.read_numbered_lines(spark, str(tmp_path))
    got = [(r["line_no"], *at(r["line"])) for r in df.collect()]
    assert len(got) == sum(map(len, lines.values())) and all(n == i + 1 for n, _, i in got)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    through = sorted((r["line_no"], *at(r["line"])) for r in O.read_numbered_lines(spark, str(tmp_path), across=True).collect())
    assert [r[0] for r in through] == list(range(1, len(got) + 1)) and [r[1:] for r in through] == sorted(r[1:] for r in through)


def test_other_splits_fail(spark, tmp_path, small_splits):
    files(tmp_path)
    df = O.read_numbered_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    with pytest.raises(Exception, match="another way"):
        df.select("line_no", "line").collect()


def without_files(tmp_path, *names):
    """A read that still wants one of these files fails."""
    for n in names:
        (tmp_path / n).unlink()


@pytest.mark.parametrize("n", [0, 1, 350, 700, 701, 702, 1000, 5000])
def test_take_reads_no_later_file(spark, tmp_path, small_splits, n):
    lines = files(tmp_path)
    df = O.take_first_lines(spark, str(tmp_path), n)
    all_lines = [(f, i) for f in lines for i in range(len(lines[f]))]
    if n <= 700:
        without_files(tmp_path, "a.log", "c%20.log", "d.log", "e.log", "f.log")  # a.log is empty
    assert sorted(at(r["line"]) for r in df.collect()) == all_lines[:n]


def test_strict_prefix_reads_no_later_file(spark, tmp_path, small_splits):
    files(tmp_path, bad={(1, 650), (3, 5), (4, 0)})
    df = O.strict_prefix_lines(spark, str(tmp_path))
    without_files(tmp_path, "c%20.log", "d.log", "e.log", "f.log")
    assert sorted(at(r["line"]) for r in df.collect()) == [(1, i) for i in range(650)]
    sound = files(tmp_path)
    assert O.strict_prefix_lines(spark, str(tmp_path)).count() == sum(map(len, sound.values()))
    files(tmp_path, bad={(2, 0)})
    assert sorted(at(r["line"]) for r in O.strict_prefix_lines(spark, str(tmp_path), first_wave=4).collect()) == [(1, i) for i in range(700)]


def test_one_output_in_order(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    lines = files(tmp_path / "in", bad={(1, 3), (1, 699), (3, 0)})
    lines = [x for f in lines for x in lines[f]]
    dealt = O.in_order(O.read_numbered_lines(spark, str(tmp_path / "in")), *O.NUMBERED, partitions=10)
    seen = C.classify_lines(dealt, parsed="v")
    O.write_in_order(O.echoed(L.render(seen, [L.arg("msg")], "v")), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 10
    written = [x for p in parts for x in p.read_text().split("\n")[:-1]]
    assert written == [x if x == "no record" else f"said {at(x)[1]}" for x in lines]
    assert [r["line"] for r in O.read_numbered_lines(spark, str(tmp_path / "out"), across=True).orderBy("line_no").collect()] == written
    with pytest.raises(ValueError):
        O.in_order(dealt, "line_no", partitions=100_000)


def test_empty_files_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("")
    (tmp_path / "b.log").write_text("\n \n{}")
    assert sorted(tuple(r)[1:] for r in O.read_numbered_lines(spark, str(tmp_path)).collect()) == [(1, ""), (2, " "), (3, "{}")]
    shown = O.echoed(C.classify_lines(O.read_numbered_lines(spark, str(tmp_path))).withColumn("text", F.lit("r")))
    assert [r["value"] for r in shown.collect()] == ["r"]
