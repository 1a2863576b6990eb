import hashlib
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline import baselines, cli, staging
from weftline.functions import lines as L
from weftline.operators import dictionary, merge, order
from weftline.options import GeneratorOptions, SortOptions, default_chunk_bytes, format_size, hardware_report, parse_size
from weftline.plans import files as plans
from weftline.plans.files import generate_file, make_runs, merge_file, rebuild_run, sort_file
from weftline.sinks import files as sinks
from weftline.plans.strategy import choose_strategy, shard_count
from weftline.sources.generator import generate_rows, phrase_pool
from weftline.sources.text_lines import parse_lines, read_run

#: Five lines, and texts by the line's number modulo 7, whose sorted files have known digests.
SPEC = ["415. Apple", "30432. Something something something", "1. Apple", "32. Cherry is the best", "2. Banana is yellow"]
MIXED = ["Apple", "Банан", "日本語", "\U00010000\U00010001\U00010002", "ﾀ{i}", "Café", "Z{i}"]


def mixed(i):
    return MIXED[i % 7].format(i=i)


#: name: lines, SHA-256 of the sorted file
GOLDEN = {
    "spec5": (SPEC, "65142df7391910708936f5f8e8daa5edb7fdb3b74aa2d26f400bd05279dcaee9"),
    "supplementary2": (["1. \U00010000", "2. ﾀ"], "fb8fc71e39c84c7a30fe901c4306ebdcecd6e7435098142d47d5681fc802637b"),
    "parity2000": ([f"{i}. {mixed(i)}" for i in range(1, 2001)], "d3d854a93e00c8a9e3eb0af149fe15fde3027f930733608c9f9ecb2f0af4e03a"),
    "mmf1000": ([f"{i % 100}. Text{i % 20}" for i in range(1, 1001)], "cb5ddbea98f3c4f5e0f7c2de6471cfa72ec1906742b5d139f67802b7b3ea3662"),
    "mmf5000": ([f"{i}. Line{i % 10}" for i in range(1, 5001)], "dbe73371ed8be5f6621c5f0db96cb3a069b708d51a298342650e1ce25d2edcba"),
    "tiny100": ([f"{i}. Line{i % 5}" for i in range(1, 101)], "eefaa5d151e1d909a59d2ec7b9a6b0ee2954d6036ecfa5cf635d92029c14ee29"),
    "phrase2000": ([f"{i % 50}. Phrase{i % 30}" for i in range(1, 2001)], "ab162372d1efb6910b168edfcf16ee4b4b63654c03d0c5950ce27161d13bd7c1"),
}


def run(spark, tmp_path, data: bytes, **options):
    (tmp_path / "in.txt").write_bytes(data)
    sort_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out.txt"), SortOptions(**options))
    return (tmp_path / "out.txt").read_bytes()


@pytest.mark.parametrize("strategy", ["stream", "mmf", "shard"])
@pytest.mark.parametrize("name", GOLDEN)
def test_golden_bytes_in_every_shape(spark, tmp_path, name, strategy):
    lines, digest = GOLDEN[name]
    out = run(spark, tmp_path, ("\n".join(lines) + "\n").encode(), strategy=strategy, partitions=5)
    assert hashlib.sha256(out).hexdigest() == digest


@pytest.mark.parametrize(
    "data, want",
    [
        (b"", b""), (b"42. Only line", b"42. Only line\n"), (b"\xef\xbb\xbf2. b\n1. a\n", b"1. a\n2. b\n"), (b"2. b\r\n1. a\r\n", b"1. a\n2. b\n"),
        (b"1. tail\r\r\n", b"1. tail\r\n"), (b"1. a\rb\n", b"1. a\rb\n"), (b"7. \n", b"7. \n"), (b"3.  two spaces\n", b"3.  two spaces\n"),
        (b"415. A. B. c\n", b"415. A. B. c\n"), (b"-5. x\n+5. x\n007. J\n", b"7. J\n-5. x\n5. x\n"), (b"12abc. Foo\n", b"12. Foo\n"),
        (b"1. \xff\xfe\n", "1. ��\n".encode()), (b"9223372036854775807. Max\n", b"9223372036854775807. Max\n"), (b"1. a\n1. a\n", b"1. a\n1. a\n"),
    ],
)
def test_edge_lines(spark, tmp_path, data, want):
    assert run(spark, tmp_path, data) == want


@pytest.mark.parametrize("line", [b"no dot here", b". missing number", b"abc. Text", b"7.", b"1.5. Foo", b" 1. lead", b"9223372036854775808. x", b""])
def test_bad_line_fails_the_job(spark, tmp_path, line):
    with pytest.raises(Exception, match="Malformed line|Empty line"):
        run(spark, tmp_path, b"1. a\n" + line + b"\n2. b\n")


def test_a_bad_line_fails_whichever_column_is_used(spark):
    for column in ("number", "text"):
        with pytest.raises(Exception, match="Malformed line"):
            parse_lines(spark.createDataFrame([("nope",)], "value string")).select(column).collect()


def test_blank_lines_skip_and_quarantine(spark, tmp_path):
    assert run(spark, tmp_path, b"2. b\n\n1. a\n", blank_lines="skip") == b"1. a\n2. b\n"
    assert run(spark, tmp_path, b"2. b\nbad\n1. a\n", on_error="quarantine") == b"1. a\n2. b\n"


def test_strict_takes_whole_tokens(spark):
    rows = spark.createDataFrame([(" 1. lead",), ("12abc. x",), ("1.5. Foo",), ("5. ok",), (None,)], "value string")
    assert [r.number for r in parse_lines(rows, strict=True, on_error="quarantine").collect()] == [1, None, None, 5, None]


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sort_file(spark, str(tmp_path / "none"), str(tmp_path / "out"))


def test_oversize_record_and_overwrite(spark, tmp_path):
    (tmp_path / "out.txt").write_text("old")
    assert run(spark, tmp_path, b"7. " + b"A" * 600_000 + b"\n") == b"7. " + b"A" * 600_000 + b"\n"


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_parallelism_never_changes_bytes(spark, tmp_path, partitions):
    rng = random.Random(7)
    rows = [(rng.randint(-50, 50), rng.choice(["b", "a", "", "zz", "é"])) for _ in range(3000)]
    want = "".join(f"{n}. {t}\n" for n, t in sorted(rows, key=lambda r: (r[1].encode(), r[0]))).encode()
    data = "".join(f"{n}. {t}\n" for n, t in rows).encode()
    assert run(spark, tmp_path, data, strategy="shard", partitions=partitions) == want


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_dictionary_sort_gives_the_same_bytes(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(plans, "DICTIONARY_BYTES", 1)
    monkeypatch.setattr(plans, "SINGLE_TASK_BYTES", 1)
    rng = random.Random(9)
    texts = ["hot"] * 30 + ["b", "a", "", "zz", "é", "\U00010000", "ﾀ", "a b"]
    rows = [(rng.choice([-(1 << 40), 0, 7, 1 << 40]) + rng.randint(-9, 9), rng.choice(texts)) for _ in range(4000)]
    want = "".join(f"{n}. {t}\n" for n, t in sorted(rows, key=lambda r: (r[1].encode(), r[0]))).encode()
    data = "".join(f"{n}. {t}\n" for n, t in rows).encode()
    assert run(spark, tmp_path, data, partitions=partitions) == want
    assert run(spark, tmp_path, b"") == b""
    with pytest.raises(Exception, match="Malformed line"):
        run(spark, tmp_path, data + b"bad\n")


def test_dictionary_fits_or_declines(spark, monkeypatch):
    few = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "number bigint, text string")
    assert dictionary.probe(few) and dictionary.sort_by_dictionary(few, 4) is not None
    many = spark.createDataFrame([(i, str(i)) for i in range(100)], "number bigint, text string")
    assert not dictionary.probe(many)
    monkeypatch.setattr(dictionary, "MOST_TEXTS", 50)
    assert dictionary.sort_by_dictionary(many, 4) is None
    for row in ((1 << 62, "a"), (None, "a"), (1, None)):
        assert dictionary.sort_by_dictionary(few.unionByName(spark.createDataFrame([row, (-(1 << 62), "b")], few.schema)), 4) is None
    assert dictionary.sort_by_dictionary(few.filter("false"), 4) is None


@pytest.mark.parametrize("ranges", [1, 4, 3000])
def test_dictionary_ranges_are_even_and_ordered(ranges):
    counts, lows, highs = [50, 9000, 70, 1, 800], [0, -500, 3, 9, 1 << 40], [9, 9999, 3, 9, 1 << 41]
    total, before, places, last = sum(counts), 0, [], -1
    for n, low, high in zip(counts, lows, highs, strict=True):
        for i in range(n):
            place = min(ranges - 1, int(dictionary.range_of(low + (high - low + 1) * i // n, before, n, low, high - low + 1, total, ranges)))
            assert place >= last  # in the order of the records
            places.append(last := place)
        before += n
    sizes = [places.count(r) for r in range(ranges)]
    assert max(sizes) <= total / ranges + 71  # a text's rows of one number stay together


def test_dictionary_sort_takes_any_number_of_ranges(spark):
    rows = spark.range(4000).selectExpr("pmod(xxhash64(id), 1000) number", "concat('t', id % 7) text")
    got = dictionary.sort_by_dictionary(rows, 1200)
    assert got.rdd.getNumPartitions() == 1200
    assert [tuple(r) for r in got.collect()] == sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[1], r[0]))


def numbered(seed, n, texts=("b", "a", "", "zz", "é", "\U00010000", "ﾀ")):
    rng = random.Random(seed)
    return "".join(f"{rng.randint(-99, 99)}. {rng.choice(texts)}\n" for _ in range(n)).encode()


def test_baselines_give_the_same_bytes(spark, tmp_path):
    data = numbered(3, 2500)
    want = run(spark, tmp_path, data)
    baselines.sort_in_memory(str(tmp_path / "in.txt"), str(tmp_path / "b1"))
    assert baselines.sort_sequentially(str(tmp_path / "in.txt"), str(tmp_path / "b2"), 400) == 7
    assert (tmp_path / "b1").read_bytes() == (tmp_path / "b2").read_bytes() == want
    (tmp_path / "in.txt").write_bytes(b"1. a\nbad\n")
    with pytest.raises(ValueError, match="Malformed line"):
        baselines.sort_in_memory(str(tmp_path / "in.txt"), str(tmp_path / "b1"))


@pytest.mark.parametrize("width", [2, 3, 64])
def test_runs_are_made_and_merged_apart(spark, tmp_path, width):
    data = numbered(4, 6000)
    want = run(spark, tmp_path, data)
    runs = make_runs(spark, str(tmp_path / "in.txt"), str(tmp_path / "runs"), SortOptions(chunk_bytes=len(data) // 6))
    assert runs >= 5
    for n in merge.run_numbers(spark, str(tmp_path / "runs")):
        rows = [(r.text.encode(), r.number) for r in spark.read.parquet(str(tmp_path / f"runs/run={n}")).collect()]
        assert rows == sorted(rows)
    assert merge_file(spark, str(tmp_path / "runs"), str(tmp_path / "merged"), SortOptions(merge_width=width)) == len(want)
    assert (tmp_path / "merged").read_bytes() == want


def test_a_level_joins_neighbouring_runs_in_order(spark, tmp_path):
    rows = spark.range(900).selectExpr("id number", "cast(xxhash64(id) as string) text", "id % 9 as n")
    merge.write_runs(rows, str(tmp_path / "runs"), "n")
    merge.merge_level(spark, str(tmp_path / "runs"), 4, str(tmp_path / "level"))
    assert merge.run_numbers(spark, str(tmp_path / "level")) == [0, 1, 2]
    for n in range(3):
        files = sorted((tmp_path / f"level/run={n}").glob("part-*"))
        got = [r.text for f in files for r in spark.read.parquet(str(f)).collect()]
        assert got == sorted(r.text for r in rows.filter(f"n div 4 = {n}").collect())
    with pytest.raises(ValueError):
        merge.merge_runs(spark, str(tmp_path / "runs"), 1)


def test_a_run_is_rebuilt_from_text(spark, tmp_path):
    (tmp_path / "t").write_bytes(b"1. a\nno separator\n2. b\n")
    rebuild_run(spark, str(tmp_path / "t"), str(tmp_path / "run"))
    assert [(r.number, r.text) for r in read_run(spark, str(tmp_path / "run")).orderBy("number").collect()] == [(1, "a"), (2, "b")]
    sinks.write_run(order.sort_lines(read_run(spark, str(tmp_path / "run"))), str(tmp_path / "first"), 1)
    assert [r.text for r in read_run(spark, str(tmp_path / "first")).collect()] == ["a"]


def test_large_results_stay_part_files(spark, tmp_path):
    data, said = numbered(5, 3000), []
    want = run(spark, tmp_path, data)
    assert sort_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "parts"), SortOptions(single_bytes=1000, partitions=4, strategy="shard"), progress=said.append) == 0
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*"))) == want
    assert "3000 records" in said[-1] and "part files" in said[0]
    with pytest.raises(ValueError, match="part files"):
        sinks.concat_parts(spark, str(tmp_path / "parts"), str(tmp_path / "one"), 1000)
    assert not (tmp_path / "one").exists()
    assert sinks.concat_parts(spark, str(tmp_path / "parts"), str(tmp_path / "one")) == len(want)


def test_full_disk_is_told_before_the_sort(spark, tmp_path, monkeypatch):
    (tmp_path / "in.txt").write_bytes(b"1. a\n" * 1000)
    asked = []

    def usage(folder):
        asked.append(folder)
        return type("Usage", (), {"free": 7000})

    monkeypatch.setattr(plans.shutil, "disk_usage", usage)
    sort_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), SortOptions(strategy="stream", temp_dir="/anywhere"))
    with pytest.raises(OSError, match="free"):
        sort_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), SortOptions(strategy="shard", temp_dir="/anywhere"))
    assert asked == ["/anywhere"] * 2


def test_the_chunk_bounds_what_a_scan_task_reads(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"1. abcdefgh\n" * 50_000)
    own = plans.chunked(spark, 50_000)
    assert own is not spark and own.read.text(str(tmp_path / "in.txt")).rdd.getNumPartitions() >= 12
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert plans.chunked(spark, 1 << 40) is spark and spark.read.text(str(tmp_path / "in.txt")).rdd.getNumPartitions() <= 8


def test_a_sort_is_cancelled_by_its_group(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(numbered(6, 400_000))
    errors = []

    def work():
        try:
            while True:
                sort_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), SortOptions(strategy="shard"), job_group="to-cancel")
        except Exception as e:
            errors.append(str(e))

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(300):
        if thread.is_alive():
            time.sleep(0.1)
            spark.sparkContext.cancelJobGroup("to-cancel")
    thread.join(60)
    assert errors and "cancel" in errors[0].lower()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_staged_tables_are_deleted(spark, tmp_path):
    staging.release(spark)
    with staging.owned(spark):
        spark.range(3).write.parquet(path := staging.staged_path(spark, "t"))
        assert spark.read.parquet(path).count() == 3
    at, fs = staging.hadoop_path(spark, path)
    assert not fs.exists(at)
    spark.range(3).write.parquet(path := staging.staged_path(spark, "t"))
    assert staging.release(spark) == 1 and staging.release(spark) == 0
    run(spark, tmp_path, b"1. a\n")
    assert staging.release(spark) == 0


def test_generator(spark, tmp_path):
    options = GeneratorOptions(phrases=10, seed=7)
    for name in ("a", "b"):
        generate_file(spark, str(tmp_path / name), 20_000, options)
    data = (tmp_path / "a").read_bytes()
    assert data == (tmp_path / "b").read_bytes()
    assert 20_000 <= len(data) < 40_000
    texts = [x.split(b". ", 1)[1] for x in data.splitlines()]
    assert len(set(texts)) == 10
    assert generate_rows(spark, 500, options, 3).exceptAll(generate_rows(spark, 500, options, 8)).isEmpty()
    assert len(set(phrase_pool(GeneratorOptions(phrases=500)))) == 500
    with pytest.raises(ValueError):
        GeneratorOptions(phrases=0)


def test_rank_on_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "number bigint, text string")
    assert order.with_rank(empty, *order.KEYS).count() == 0
    rows = spark.createDataFrame([(1, None), (None, "a"), (1, None)], "number bigint, text string")
    assert sorted(r.rn for r in order.with_rank(rows, *order.KEYS).collect()) == [1, 2, 3]
    assert order.violations(spark.createDataFrame([(1, "b", 1), (1, "a", 2), (0, "a", 3)], "number bigint, text string, rn bigint")).first()[0] == 2


def test_ranks_follow_the_order_of_any_plan_and_names_may_clash(spark):
    rows = spark.range(500).selectExpr("cast(xxhash64(id) % 50 as bigint) number", "cast(id % 7 as string) text", "id as at", "1 as _at", "2 as part", "3 as rn2")
    for made in (order.sort_lines(rows), order.sort_single(rows), order.sort_shard(rows, 5)):
        assert "Sort" in made._jdf.queryExecution().executedPlan().toString()
        got = order.ranked(made).orderBy("rn").collect()
        assert [r.rn for r in got] == list(range(1, 501)) and got[0].asDict().keys() == {*rows.columns, "rn"}
        assert [(r.text, r.number) for r in got] == sorted((r.text, r.number) for r in got)


def test_first_seen_breaks_ties_by_position(spark):
    rows = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, "a", 8), (2, None, 9), (2, None, 9), (3, "b", 1)], "number bigint, text string, at int").coalesce(1)
    got = [(r.number, r.text, r.seen_before) for r in order.first_seen(rows).collect()]
    assert sorted(got, key=repr) == sorted([(1, "a", True), (1, "a", True), (None, "a", False), (2, None, False), (2, None, True), (3, "b", False)], key=repr)
    assert order.first_seen(rows.filter("false")).count() == 0


def test_hardware_report():
    lines = hardware_report(SortOptions(chunk_bytes=1 << 20, threads=3), 5, 8 << 30)
    assert "parallelism 5" in lines[0] and "8.0 GB" in lines[0] and "1 MB" in lines[1] and "merge width 64" in lines[2]


def test_sizes_and_strategy():
    assert [parse_size(x) for x in ("10KB", " 1.5 mb", "2GB", "77")] == [10240, 1572864, 2 << 30, 77]
    for bad in ("1TB", "x", "1e3KB", "5B"):
        with pytest.raises(ValueError):
            parse_size(bad)
    assert [format_size(x) for x in (12, 1536, 5 << 20, 3 << 29)] == ["12 B", "2 KB", "5 MB", "1.5 GB"]
    assert choose_strategy("auto", 10, 10, 8) == "mmf" and choose_strategy("auto", 40, 10, 4) == "shard" and choose_strategy("auto", 39, 10, 8) == "stream"
    with pytest.raises(ValueError):
        choose_strategy("quick", 1, 1, 1)
    assert shard_count(8, 100, 64, 64) == 1 and shard_count(4, 8192, 10, 64) == 4
    assert default_chunk_bytes(64 << 30) == 8 << 30 and default_chunk_bytes(4 << 30) == 1 << 30


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["generate", str(tmp_path / "g"), "5KB", "--phrases", "20"]) == 0
    assert cli.main(["sort", str(tmp_path / "g"), str(tmp_path / "s"), "--memory", "1MB", "--threads", "4", "--unknown"]) == 0
    lines = (tmp_path / "s").read_bytes().splitlines()
    assert lines == sorted(lines, key=lambda x: (x.split(b". ", 1)[1], int(x.split(b".")[0]))) and len(lines) > 10
    assert cli.main(["sort", str(tmp_path / "none"), str(tmp_path / "s")]) == 1
    assert cli.main([]) == 1


def test_size_format_of_all_longs(spark):
    sizes = [0, -1, 1023, 1536, (1 << 20) - 1, (1 << 30) - 1, 1 << 30, (1 << 30) * 20 - 54_000_000, (1 << 59) + 3, 600_000_000_000_000_000 // 7 * 7, 1_199_999**3, (1 << 63) - 1]
    sizes += [x * (1 << 30) + (1 << 30) * d // 20 + e for x in (1, 9, 99, 1 << 31, (1 << 33) - 2) for d in range(1, 20, 2) for e in (-1, 0, 1)]
    got = spark.createDataFrame([(x,) for x in sizes], "size bigint").select("size", L.size_format(F.col("size")).alias("shown")).collect()
    assert [r["shown"] for r in got] == [format_size(r["size"]) for r in got]
