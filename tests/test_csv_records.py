"""Records of multi-line CSV files, split into small byte ranges, against Python's csv reader."""
import csv
import io
import os
import random

import pytest

from tessera.sources.csv import read_csv, read_strings
from tessera.sources.csv_records import records, states_before


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(rnd):
    text = "".join(rnd.choice(['a', 'é', ',', '"', '\n', '\r\n', ' ', '""', '",', '\n"', 'xyz', '中'])
                   for _ in range(rnd.randrange(12)))
    return rnd.choice([text, text, "plain", "", str(rnd.random()), "long " * rnd.randrange(3000) + "\nend"
                       if rnd.random() < 0.02 else "x"])


def write(path, rows, header=("id", "b, c", 'd"e'), end="\r\n", encoding="utf-8", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding=encoding) as f:
        w = csv.writer(f, lineterminator=end, quoting=quoting)
        w.writerow(header)
        w.writerows(rows)


def expected(path, encoding="utf-8"):
    rows = list(csv.reader(io.StringIO(open(path, newline="", encoding=encoding).read(), newline="")))
    return sorted(tuple(v or None for v in r) for r in rows[1:])


def got(df):
    return sorted((tuple(v or None for v in r) for r in df.collect()), key=lambda r: tuple(v or "" for v in r))


@pytest.mark.parametrize("seed, end, quoting", [(1, "\n", csv.QUOTE_MINIMAL), (2, "\r\n", csv.QUOTE_ALL),
                                                (3, "\r\n", csv.QUOTE_MINIMAL)])
def test_folder_of_files_equals_the_csv_reader(spark, tmpdir_path, small_ranges, seed, end, quoting):
    rnd, want = random.Random(seed), []
    for n in range(3):
        rows = [(str(n * 10_000 + i), field(rnd), field(rnd)) for i in range(400)]
        write(f"{tmpdir_path}/f{n}.csv", rows, end=end, quoting=quoting)
        want += expected(f"{tmpdir_path}/f{n}.csv")
    df = read_strings(spark, tmpdir_path, "UTF-8", True)
    assert df.columns == ["id", "b, c", 'd"e']
    assert got(df) == sorted(want, key=lambda r: tuple(v or "" for v in r))
    size = sum(os.path.getsize(f"{tmpdir_path}/{f}") for f in os.listdir(tmpdir_path) if f.endswith(".csv"))
    assert df.rdd.getNumPartitions() >= size // 8192 > 5


def test_a_record_over_many_ranges_and_an_open_end(spark, tmpdir_path, small_ranges):
    long = "\n".join(f'line {i}, "quoted"' for i in range(3000))
    write(f"{tmpdir_path}/a.csv", [("1", long, "x"), ("2", "y", long)], end="\n")
    with open(f"{tmpdir_path}/a.csv", "a") as f:
        f.write('3,"never\nclosed')
    rows = {r["id"]: tuple(r) for r in read_strings(spark, tmpdir_path, "UTF-8", True).collect()}
    assert rows["1"] == ("1", long, "x") and rows["2"] == ("2", "y", long) and "closed" in rows["3"][1]


def test_stray_quotes_blank_lines_and_a_byte_order_mark(spark, tmpdir_path, small_ranges):
    """A quote inside an unquoted field opens nothing, whatever the parity says."""
    with open(f"{tmpdir_path}/a.csv", "w", encoding="utf-8-sig", newline="") as f:
        f.write('"id",b,c\n1,5" disk,x\n\n2,"two\nlines",3\' 4"\n3,"",""""\n' + '4,6" disk,y\n' * 1500)
    rows = sorted((tuple(r) for r in read_strings(spark, tmpdir_path).collect()), key=str)
    assert rows[:3] == [("1", '5" disk', "x"), ("2", "two\nlines", "3' 4\""), ("3", rows[2][1], '"')]
    assert rows[3:] == [("4", '6" disk', "y")] * 1500


def test_other_encoding_and_types(spark, tmpdir_path, small_ranges):
    rows = [(str(i), f"caf\xe9\n{i}", str(i / 2)) for i in range(1200)]
    write(f"{tmpdir_path}/a.csv", rows, header=("id", "t", "v"), encoding="latin-1")
    df = read_csv(spark, tmpdir_path)
    assert dict(df.dtypes) == {"id": "bigint", "t": "string", "v": "double"}
    assert sorted(df.collect()) == [(i, f"caf\xe9\n{i}", i / 2) for i in range(1200)]


def test_states_of_lines_compose():
    rnd = random.Random(9)
    import numpy as np
    for _ in range(200):
        f = [(rnd.random() < 0.5, rnd.random() < 0.5) for _ in range(rnd.randrange(12))]
        out, in_ = (np.array([x[i] for x in f], bool) for i in (0, 1))
        for first in (False, True):
            want = [first]
            for x in f:
                want.append(x[want[-1]])
            assert states_before(out, in_, first).tolist() == want


def test_empty_file(spark, tmpdir_path):
    open(f"{tmpdir_path}/a.csv", "w").write("a,b\n")
    assert records(spark, tmpdir_path).where("not first").count() == 0
    assert read_strings(spark, tmpdir_path, "UTF-8", True).collect() == []
