import gzip
import random
import zlib

import pytest

from strandsift.sources import fasta, ranges
from test_sequence import EDGE, parsed


def blocked(data, size):
    """``data`` as gzip members of ``size`` bytes each that state their size, with an empty one in between and at the end."""
    out = b""
    for part in [data[k : k + size] for k in range(0, len(data), size)] + [b""]:
        for one in (part, b"") if len(part) == size and len(out) % 3 == 0 else (part,):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = squeeze.compress(one) + squeeze.flush()
            head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + (6).to_bytes(2, "little") + b"BC" + (2).to_bytes(2, "little")
            out += head + (len(head) + 2 + len(body) + 8 - 1).to_bytes(2, "little") + body + zlib.crc32(one).to_bytes(4, "little") + len(one).to_bytes(4, "little")
    return out


def made(seed, records=60):
    """Records with lines of all lengths and ends, blank lines, indented headers, a long record and an empty one."""
    draw = random.Random(seed)
    out = "left out\n"
    for i in range(records):
        end = draw.choice(["\n", "\r\n", "\r"])
        out += draw.choice(["", "  "]) + f">r{i} note" + end
        for _ in range(draw.choice([0, 1, 3, 200 if i == 7 else 2])):
            out += "".join(draw.choices("ACDefß ", k=draw.randint(0, 70))) + end
    return out


def in_ranges(path, size):
    files = ranges.list_files(str(path))
    return [(n, s) for p in ranges.plan_ranges(files, size) for _, n, s in ranges.read_range(p)]


@pytest.mark.parametrize("seed", range(4))
def test_every_range_size_gives_each_record_once(tmp_path, seed):
    text = made(seed)
    data = text.encode()
    want = parsed(text)
    (tmp_path / "a.fasta").write_bytes(data)
    for size in (2, 13, 14, 31, 64, 1000, 5000, 10**6):
        assert in_ranges(tmp_path / "a.fasta", size) == want
    for member in (11, 300, 60_000):
        (tmp_path / "b.fasta.gz").write_bytes(blocked(data, member))
        assert gzip.open(tmp_path / "b.fasta.gz").read() == data
        assert ranges.kind_of(str(tmp_path / "b.fasta.gz")) == "blocks"
        for size in (100, 1000, 70_000):
            assert in_ranges(tmp_path / "b.fasta.gz", size) == want


def test_equals_the_text_reader(spark, tmp_path):
    for name, text in (("a.fasta", made(9)), ("b.fasta", EDGE), ("c.fasta", ""), ("d.fasta", "﻿>x y\nac \n")):
        (tmp_path / name).write_text(text, newline="")
    with gzip.open(tmp_path / "e.fasta.gz", "wb") as f:
        f.write(made(10).encode())
    with gzip.open(tmp_path / "e.fasta.gz", "ab") as f:  # a second member
        f.write(b">last\nAC\n")
    (tmp_path / "f.fasta.gz").write_bytes(blocked(made(11).encode(), 500))
    (tmp_path / "_skipped").write_text(">no\n")
    pick = lambda df: sorted((r.path.rsplit("/", 1)[1], r.id, r.seq) for r in df.collect())
    read = ranges.read_ranges(spark, str(tmp_path), range_bytes=700)
    assert read.rdd.getNumPartitions() > 10
    assert pick(read) == pick(fasta.read_fasta(spark, str(tmp_path)))
    order = [r.id for r in read.where("path like '%a.fasta'").orderBy("offset").collect()]
    assert order == [r.id for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("seq_no").collect()]
    assert pick(ranges.read_ranges(spark, f"file://{tmp_path}/[ab].fast?")) == pick(fasta.read_fasta(spark, f"{tmp_path}/[ab].fasta"))


def test_a_large_block_file_is_read_by_many_tasks(spark, tmp_path):
    text = "".join(f">r{i}\n{'ACDEFGHIKL' * (i % 90)}\n" for i in range(20_000))
    (tmp_path / "x.gz").write_bytes(blocked(text.encode(), 60_000))
    with gzip.open(tmp_path / "y.gz", "wb") as f:
        f.write(text.encode())
    size = (tmp_path / "x.gz").stat().st_size
    df = ranges.read_ranges(spark, str(tmp_path / "x.gz"), range_bytes=size // 7)
    assert df.rdd.getNumPartitions() == -(-size // (size // 7))
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) >= 7
    assert [(r.id, len(r.seq)) for r in df.orderBy("offset").collect()] == [(f"r{i}", 10 * (i % 90)) for i in range(20_000)]
    assert ranges.read_ranges(spark, str(tmp_path / "y.gz"), range_bytes=1000).rdd.getNumPartitions() == 1


def test_errors_and_nothing(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">\nACD\n")
    with pytest.raises(Exception, match="without an id"):
        ranges.read_ranges(spark, str(tmp_path / "x.fasta")).collect()
    assert ranges.read_ranges(spark, str(tmp_path / "x.fasta"), "PERMISSIVE").first().id is None
    with pytest.raises(Exception, match="FileNotFound|none.fasta"):
        ranges.read_ranges(spark, str(tmp_path / "none.fasta")).collect()
    assert ranges.read_ranges(spark, str(tmp_path / "*.none")).count() == 0
    with gzip.open(tmp_path / "cut.gz", "wb") as f:
        f.write(made(1, 400).encode())
    whole = (tmp_path / "cut.gz").read_bytes()
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends within"):
        ranges.read_ranges(spark, str(tmp_path / "cut.gz")).collect()


def test_a_stopped_stream_resumes(spark, tmp_path):
    def go():
        query = ranges.stream_ranges(spark, str(tmp_path / "in"), range_bytes=100).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("".join(f">a{i}\nACD\n" for i in range(50)))
    first = [f"a{i}" for i in range(50)]
    assert go() == sorted(first)
    assert go() == sorted(first)
    (tmp_path / "in" / "b.gz").write_bytes(blocked("".join(f">b{i}\nACD\n" for i in range(30)).encode(), 40))
    assert go() == sorted(first + [f"b{i}" for i in range(30)])
