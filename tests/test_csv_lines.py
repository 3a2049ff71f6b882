"""CSV files with quoted line breaks against the csv module."""

import csv
import io
import json
import random

import pytest

from flowsift.functions.csv import split_cells
from flowsift.sources import csv_lines, records
from flowsift.sources.decode import decode_records


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few bytes, so that most line breaks are near a border."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def brute(text):
    """(names, rows) of the csv module, blank rows left out."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    return rows[0], rows[1:]


def read(spark, path):
    names, rows = csv_lines.scan_records(spark, str(path))
    found = sorted((r.position, r.cells) for r in rows.collect())
    assert [p for p, _ in found] == list(range(len(found)))
    return names, [c for _, c in found]


def test_cells_equal_the_csv_module(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice('ab,"" \x01\x02\x03é') for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    texts += ['"a""b"', '"a"b,c', 'a"b"', '""', '"', ",", '"x,y"\r', '"\x01",\x01\x03', "a\r", '"\r",b']
    texts += ['""' * 2000 + ",x", '"' + '""' * 2000 + '",x']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_cells(df_col()).alias("cells"))
    for t, cells in df.collect():
        assert cells == next(csv.reader(io.StringIO(t, newline=""))), t


def df_col():
    from pyspark.sql import functions as F

    return F.col("t")


def test_quoted_break_is_one_record(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('k,note\n1,"two\nlines"\n2,plain\n')
    assert read(spark, path) == (["k", "note"], [["1", "two\nlines"], ["2", "plain"]])


@pytest.mark.parametrize("block", [31, 100_000])
@pytest.mark.parametrize("seed", range(2))
def test_random_files_at_any_block_size(spark, tmp_path, tiny_blocks, block, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(['a', 'b', ' ', ',', '"', '""', '\n', '\n\n', '\r\n', 'é']) for _ in range(rng.randint(0, 6)))
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["a", 'the "b"\nname', "c"])
    for _ in range(12):
        writer.writerow([cell() for _ in range(rng.choice([3, 3, 3, 1, 5]))])
        out.write(rng.choice(["", "", "\n", '"open\n\nand shut" tail,x"y\n', 'a"b,"c ""d"\n']))
    text = out.getvalue()
    path = tmp_path / "up.csv"
    path.write_bytes(text.encode())
    tiny_blocks(block)
    assert read(spark, path) == brute(text)


def test_long_cell_over_many_blocks(spark, tmp_path, tiny_blocks):
    text = "k,note\n0,x\n" + "\n".join(f'{i},"' + "line, of it\n" * 40 + '"' for i in range(1, 6)) + "\n6,end"
    (tmp_path / "up.csv").write_text(text)
    tiny_blocks(120)
    assert csv_lines.scan_lines(spark, str(tmp_path / "up.csv")).select("part", "block").distinct().count() > 20
    assert read(spark, tmp_path / "up.csv") == brute(text)


def test_folder_of_files(spark, tmp_path):
    folder = tmp_path / "up.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"x\ny"\n')
    (folder / "b.csv").write_text("k,v\n")
    (folder / "c.csv").write_text('\nk,v\r\n2,"never closed\n')
    (folder / "d.csv").write_text("k,v\n3,z")
    (folder / "e.csv").write_text("")
    names, rows = read(spark, folder)
    assert names == ["k", "v"] and rows == [["1", "x\ny"], ["2", "never closed"], ["3", "z"]]
    (folder / "f.csv").write_text("k,w\n")
    with pytest.raises(ValueError, match="different headers"):
        csv_lines.scan_records(spark, str(folder))


def test_carriage_return_outside_quotes_is_refused(spark, tmp_path):
    (tmp_path / "up.csv").write_bytes(b"a,b\n1\r2,3\n")
    log = str(tmp_path / "log")
    with pytest.raises(Exception, match="carriage return"):
        records.ingest_csv(spark, str(tmp_path / "up.csv"), log, "lab")
    assert records.read_log(spark, log).count() == 0


def test_documents_equal_the_reader(spark, tmp_path):
    text = 'k,n,k,N,a.b\n1,2,3,4,5\n1\n1,2,3,4,5,"six\n6",7\n,"",""""\n"q\x01,",é,\t,x,\\\n'
    (tmp_path / "up.csv").write_text(text)
    log = str(tmp_path / "log")
    want = [dict(r) for r in csv.DictReader(io.StringIO(text))]
    assert records.ingest_csv(spark, str(tmp_path / "up.csv"), log, "lab") == len(want)
    stored = records.dataset_scan(spark, log, "lab").orderBy("id").collect()
    assert [r.id for r in stored] == [1, 2, 3, 4, 5]
    assert [json.loads(r.row_data) for r in stored] == [json.loads(json.dumps(w)) for w in want]
    decoded = decode_records(records.dataset_scan(spark, log, "lab")).orderBy("id").collect()
    assert json.loads(decoded[2]["data"]["null"]) == ["six\n6", "7"]


def test_blocks_are_composed_in_file_order():
    block = lambda path, start, out, into: {
        "part": 0, "block": start, "path": path, "start": start,
        "nth_out": out[0], "after_out": out[1], "nth_in": into[0], "after_in": into[1],
    }
    blocks = [
        block("b", 0, (2, False), (1, False)),
        block("a", 9, (7, False), (1, True)),
        block("a", 0, (3, True), (2, False)),
        block("a", 20, (5, False), (4, False)),
    ]
    assert compose(blocks) == [(0, False, 0, 0, 1), (9, True, 3, 0, 1), (20, True, 4, 0, 1), (0, False, 8, 8, 2)]


def compose(blocks):
    return [(b, inside, before, first, headers) for _, b, _, inside, before, first, headers in csv_lines.compose_blocks(blocks)]
