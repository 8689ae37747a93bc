"""CSV in splits: the same rows as the reader that takes a file in one task, whatever the borders."""

import random

import numpy as np
import pyarrow as pa
import pytest
from quillon.sources import csv_splits, files


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "70b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def plain(spark, *paths):
    return spark.read.options(**files.CSV).csv(list(paths))


def rows(df):
    """The reader of whole files turns \\r\\n inside quotes into \\n where it took \\r\\n for the line end; that is left out of the comparison."""
    return sorted((tuple(x.replace("\r\n", "\n") if isinstance(x, str) else x for x in r) for r in df.collect()), key=repr)


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return f"file://{path}"


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


def made(seed, n=120):
    rng = random.Random(seed)
    pieces = ["a", " ", ",", '"', "\n", "\n\n", "\r\n", "é", "x" * 30, "\\", "'", '""', "\n" * 40]
    lines = ["command_line,process_name,total_occurrences"]
    for i in range(n):
        value = "".join(rng.choices(pieces, [9, 4, 3, 3, 3, 1, 1, 1, 1, 1, 1, 1, 0.2], k=rng.randint(1, 14)))
        bare = f"cmd {i} \"q\" it's 5\" disk"
        lines.append(f"{rng.choice([quoted('k' + value), bare])},{rng.choice(['', 'p.exe', quoted(''), quoted('a,b')])},{i}")
        lines += [""] * rng.choice([0, 0, 1])
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(4))
def test_as_the_reader_of_whole_files(spark, tmp_path, small_splits, seed):
    path = written(tmp_path, "a.csv", made(seed))
    got = csv_splits.read(spark, path)
    want = plain(spark, path)
    assert got.columns == want.columns and rows(got) == rows(want)
    text = spark.read.option("lineSep", "\n").text(path)
    assert text.rdd.getNumPartitions() > 20 and want.rdd.getNumPartitions() == 1  # many tasks' work, where there was one's


def test_many_files_and_a_record_over_many_splits(spark, tmp_path, small_splits):
    one = written(tmp_path, "one.csv", 'a,b\n1,"' + "line\n" * 400 + '"\n2,y\n')
    two = written(tmp_path, "two.csv", "a,b\n3,z")
    three = written(tmp_path, "three.csv", "a,b\n")
    assert rows(csv_splits.read(spark, one, two, three)) == rows(plain(spark, one, two, three))
    assert rows(csv_splits.read(spark, f"file://{tmp_path}")) == rows(plain(spark, one, two, three))


def test_head_over_splits_and_schema(spark, tmp_path, small_splits):
    path = written(tmp_path, "h.csv", '\n\n"first\ncolumn ' + "x" * 100 + '\nstill",b\nv,1\n"w\nw",\n')
    assert rows(csv_splits.read(spark, path, schema="u string, v int")) == [("v", 1), ("w\nw", None)]


def test_line_ends_inside_quotes_stay(spark, tmp_path, small_splits):
    path = written(tmp_path, "e.csv", 'a,b\r\n"x\r\ny","z\nz"\r\n')
    assert [tuple(r) for r in csv_splits.read(spark, path).collect()] == [("x\r\ny", "z\nz")]


def test_states_compose_like_a_walk_over_all_lines():
    """What lines do to the state, against a walk character by character."""
    rng = random.Random(5)

    def walk(line, inside):
        i, start = 0, not inside
        while i < len(line):
            if inside:
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = False
                        start = False
            elif start and line[i] == '"':
                inside, start = True, False
            else:
                start = line[i] == ","
            i += 1
        return inside

    lines = ["".join(rng.choices('ab,""', k=rng.randint(0, 9))) for _ in range(3000)]
    # behind a closing quote another one would be neither an end nor a pair: no writer gives that
    lines = [x for x in lines if '"a"' not in x and '"b"' not in x]
    out, in_ = csv_splits.line_states(pa.array(lines))
    assert out.tolist() == [walk(x, False) for x in lines] and in_.tolist() == [walk(x, True) for x in lines]
    for begin in (False, True):
        state, want = begin, []
        for x in lines:
            state = walk(x, state)
            want.append(state)
        assert np.array_equal(csv_splits.after_each(out, in_, begin), want)


def test_commands_by_splits(spark, tmp_path, small_splits):
    path = written(tmp_path, "c.csv", made(9))
    got = files.read_commands(spark, path)
    assert rows(got) == rows(files.read_commands(spark, path, whole_files=True))
