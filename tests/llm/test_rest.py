"""Pseudonyms, archives, mixing, quality rules and the pipeline."""

import base64
import datetime
import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linemill.llm import mixing, pii, quality_rules, warc
from linemill.llm._common import cut_lineage, fresh_dir
from linemill.llm.queries import op6_warc

KEY = "k"


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def moved(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(frame, KEY).orderBy("doc_id").collect()]


def brute_digits(digits, tweak):
    """The keyed network in plain Python."""
    u = len(digits) // 2
    left, right, a, b = int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u)
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f % a) % a, right) if i % 2 == 0 else (left, (right + f % b) % b)
    return f"{left:0{u}d}{right:0{len(digits) - u}d}"


def test_cards_phones_and_links(spark):
    card, spaced = "4845168114407329", "4845 1681 1440 7329"
    a, b, c, d = moved(spark, f"x {card}, y", f"{spaced}.", "+1 (017) 555-7713", "no card: 4845168114407328")
    new = re.search(r"\d{16}", a)[0]
    assert luhn(new) and new != card and new[:15] == brute_digits(card[:15], "card")
    assert b == f"{new[:4]} {new[4:8]} {new[8:12]} {new[12:]}."
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", c) and re.sub(r"\D", "", c)[1:] == brute_digits("0175557713", "phone")
    assert d == "no card: 4845168114407328"


def test_other_kinds(spark):
    iban = "DE89370400440532013000"
    texts = moved(spark, f"a {iban} b", "on 1999-12-31.", "31.12.1999", "12/31/1999", "ssn 123-45-6789", "at 10.1.2.3:80", "mail und.34@mail7.example.com now", "DE00370400440532013000", "1999-13-41 999.1.2.3 4.0.")
    new = texts[0].split()[1]
    assert new != iban and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert re.fullmatch(r"on \d{4}-\d{2}-\d{2}\.", texts[1]) and texts[1] != "on 1999-12-31."
    year, month, day = texts[1][3:-1].split("-")
    assert texts[2] == f"{day}.{month}.{year}" and texts[3] == f"{month}/{day}/{year}"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", texts[4]) and texts[4] != "ssn 123-45-6789"
    assert re.fullmatch(r"at \d+\.\d+\.\d+\.\d+:80", texts[5]) and texts[5] != "at 10.1.2.3:80"
    assert "und.34" not in texts[6] and re.fullmatch(r"mail [a-p]{16}@mail\.invalid now", texts[6])
    assert texts[7:] == ["DE00370400440532013000", "1999-13-41 999.1.2.3 4.0."]


def iban_holds(value):
    flat = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def test_account_numbers_among_words(spark):
    spanish, austrian, card = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "4845 1681 1440 7329"
    words = ["EUR", "BIC", "2024", "2024-01-02", "EUR BIC 1", "x"]
    texts = moved(spark, f"to {spanish}", *[f"to {spanish} {w}" for w in words])
    new = texts[0][3:]
    assert new != spanish and iban_holds(new) and re.fullmatch(r"ES\d\d( \d{4}){5}", new)
    day = moved(spark, "2024-01-02")[0]
    assert texts[1:] == [f"to {new} {day if w == '2024-01-02' else w}" for w in words]
    other, hidden = moved(spark, austrian)[0], moved(spark, card)[0]
    assert other != austrian and hidden != card
    refused = f"NR12 {card}", "AB12 " + spanish, "NR" + card.replace(" ", "")
    told = f"NR12 {hidden}", "AB12 " + new, "NR" + hidden.replace(" ", "")
    assert tuple(moved(spark, *refused)) == told
    listed = f"{austrian} {spanish} {card} {spanish}\nAB12 CDEF GHIJ {card}, {austrian.replace(' ', '')}"
    assert moved(spark, listed) == [f"{other} {new} {hidden} {new}\nAB12 CDEF GHIJ {hidden}, {other.replace(' ', '')}"]
    stays = ["ES92 2100 0418 4502 0005 1332 EUR", "DE00 3704 0044 0532 0130 00", "AB12 CDEF GHIJ KLMN"]
    assert moved(spark, *stays) == stays


def test_digits_are_permuted(spark):
    found = spark.range(1000).select(pii._permuted_digits(F.lpad(F.col("id").cast("string"), 3, F.lit("0")), KEY, "t").alias("d")).collect()
    assert len({r["d"] for r in found}) == 1000 and all(len(r["d"]) == 3 for r in found)


@pytest.mark.parametrize("form", ["MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"])
def test_no_two_dates_of_a_form_get_one_pseudonym(spark, form):
    days = spark.range(pii.DAYS_LEFT * pii.DAYS_RIGHT).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), form).alias("d"))
    moved_days = days.select("d", pii._date(F.col("d"), KEY).alias("p"))
    if form == "dd/MM/yyyy":  # those that are no month-first dates come out day first again
        moved_days = moved_days.where(F.substring("d", 1, 2).cast("int") > 12).cache()
        assert moved_days.where(F.substring("p", 1, 2).cast("int") <= 12).count() == 0
    n = moved_days.count()
    assert n > 40_000 and moved_days.select("p").distinct().count() == n and moved_days.join(days.select(F.col("d").alias("p")), "p", "left_anti").count() == 0


def brute_pair(left, right, most_left, most_right, tweak):
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f % most_left) % most_left, right) if i % 2 == 0 else (left, (right + f % most_right) % most_right)
    return left, right


def test_kinds_against_plain_python(spark):
    """Addresses, days, account numbers and mail, recomputed value by value."""
    draw = random.Random(3)
    octets = [[draw.randrange(256) for _ in range(4)] for _ in range(30)]
    for o, found in zip(octets, moved(spark, *[".".join(map(str, o)) for o in octets])):
        left, right = brute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        assert found == f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
    first = datetime.date(1900, 1, 1)
    numbers = [draw.randrange(pii.DAYS_LEFT * pii.DAYS_RIGHT) for _ in range(30)]
    for n, found in zip(numbers, moved(spark, *[(first + datetime.timedelta(n)).isoformat() for n in numbers])):
        left, right = brute_pair(*divmod(n, pii.DAYS_RIGHT), pii.DAYS_LEFT, pii.DAYS_RIGHT, "date")
        assert found == (first + datetime.timedelta(left * pii.DAYS_RIGHT + right)).isoformat()
    account = lambda digits: f"DE{98 - int(digits + '131400') % 97:02d}{digits}"
    accounts = ["".join(draw.choice("0123456789") for _ in range(18)) for _ in range(30)]
    for a, found in zip(accounts, moved(spark, *map(account, accounts))):
        assert found == account(brute_digits(a, "iban"))
    for name, found in zip(("A.b@x.org", "a.b@x.org"), moved(spark, "A.b@x.org", "a.b@x.org")):
        letters = hashlib.sha256(f"{KEY}|mail|{name.lower()}".encode()).hexdigest()[:16].translate(str.maketrans("0123456789", "ghijklmnop"))
        assert found == f"{letters}@mail.invalid"
    stays = ["01.2.3.4", "DE99370400440532013000"]
    assert moved(spark, *stays) == stays


def test_odd_texts_stay(spark):
    odd = [None, "", "  \n", "no data 12 here", "é" * 70_000 + " 5", "a@b"]
    assert moved(spark, *odd) == odd
    long = "word " * 50_000 + "4845168114407329"
    assert moved(spark, long)[0][:-16] == long[:-16]


def test_archive_round_trip(spark):
    rows = [(1, "u1", "same"), (5, "u\r\n2", "same"), (3, "u3", None), (4, None, ""), (None, "u5", "same"), (7, "u7", "x\r\n\r\ny" * 40_000), (5, "u2", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(2)
    folder = fresh_dir(spark, "test")
    written = cut_lineage(warc.write_archives(pages, folder, archive_bytes=1000))
    found = Counter((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, folder, written).collect())
    name = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    s = name("same")
    assert found == Counter([("1", "revisit", "5", 4, s), ("5", "response", None, 4, s), ("5", "response", None, 4, s), (None, "revisit", "5", 4, s), ("3", "revisit", "4", 0, name("")), ("4", "response", None, 0, name("")), ("7", "response", None, 240_000, name(rows[5][2]))])
    none = cut_lineage(warc.write_archives(pages.limit(0), folder2 := fresh_dir(spark, "test")))
    assert warc.read_archives(spark, folder2, none).count() == 0


def test_broken_archives():
    import zstandard

    record = warc.record_bytes("1", "u", warc.payload_digest(b"abc"), b"abc", None)
    words = b"dictionary words " * 40
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    packed = zstandard.ZstdCompressor().compress(words)
    for dictionary in (words, packed):  # the dictionary may be compressed itself
        raw = warc.archive_head(dictionary) + coder.compress(record) * 2
        assert [warc.parse_record(r)["payload"] for r in warc.read_archive(raw)] == [b"abc"] * 2
    for bad in (raw[:-3], raw + b"junk", struct.pack("<II", warc.SKIPPABLE, 10**6) + b"x"):
        with pytest.raises(warc.BadRecord):
            list(warc.read_archive(bad))
    for bad in (record[:-1], record.replace(b"abc", b"abd"), record.replace(b"WARC/1.1", b"WARC/0.1"), record.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)


def test_archives_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    last = {}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    for key, body in rows:
        last[body] = max(key, last.get(body, key))
    told = Counter((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if last[body] == key else ("revisit", last[body]))) for key, body in rows)
    found = op6_warc(spark, sf_dir)
    assert Counter(tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == told
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_dictionary_is_a_trained_one():
    import zstandard

    records = [warc.record_bytes(str(i), f"https://example.org/{i}", "", (f"<html><head><title>page {i}</title></head><body><p>text {i * 7919 % 1000}</p></body></html>" * 20).encode(), None) for i in range(256)]
    assert zstandard.ZstdCompressionDict(warc.dictionary_of(records)).dict_id()
    assert warc.dictionary_of([b"abc"]) == b"abc" and warc.dictionary_of([]) == b""


def water_levels(sizes, weights, total, most):
    """Targets by bisection of the common level."""
    low, high = 0.0, 10.0 * total
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(most * s, level * w) for s, w in zip(sizes, weights)]


def test_mixing(spark):
    rows = [(i, ["b", "a", None, "c"][i % 4], "w " * (i % 37 * (1 if i % 4 else 5))) for i in range(2000)] + [(None, "a", "x y"), (1, "b", "x"), (9000, "empty", ""), (9001, "empty", None)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, size long")
    found = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again)) and len(found) == len(rows)
    names = ["a", "b", "c", "empty", None]
    sizes = [sum(r["size"] for r in found if r["source"] == n) for n in names]
    targets = water_levels(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes), 2.0)
    for n, s, t in zip(names, sizes, targets):
        mine = [r for r in found if r["source"] == n]
        assert {r["source_size"] for r in mine} == {s} and all(math.isclose(r["target"], t, rel_tol=1e-6, abs_tol=1e-6) for r in mine)
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - t) <= 0.02 * t + 200 and all(r["copies"] <= 2 for r in mine)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_chance_of_a_copy_is_the_fraction_at_any_size(spark):
    """Over 400 sources that are alike, documents alone in their size class and among many have the same chance."""
    sizes = [1, 2, 5, 9, 20, 40, 70, 150, 300, 600] + [12] * 6 + [100, 101, 110, 120]
    rows = [(i, f"s{s}", "w " * n) for s in range(400) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r["doc_id"]: r["n"] / 400 for r in mixing.mix(frame, weights=(1,), total=1.3).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    # The standard deviation of a mean of 400 draws is 0.023.
    assert all(abs(taken[i] - 1.3) < 0.08 for i in range(len(sizes)))
    assert abs(sum(taken.values()) / len(sizes) - 1.3) < 0.02


def test_classes_take_what_is_due(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("a "), F.when(F.col("id") % 2 == 0, 3).otherwise(40)).alias("text"))
    for s in range(3):
        found = {r["size"]: r["n"] for r in mixing.mix(frame, total=1.3, seed=s).groupBy("size").agg(F.sum("copies").alias("n")).collect()}
        assert all(abs(n - 2600) <= 8 for n in found.values())


def test_equal_rows_share_the_copies(spark):
    same = spark.range(3001).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"), F.create_map(F.lit("k"), F.lit(1)).alias("extra"))
    other = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"), F.create_map(F.lit("k"), F.col("id").cast("int")).alias("extra"))
    frame = same.union(other)
    found = mixing.mix(frame, total=1.3)
    counts = {(r["copies"]): r["count"] for r in found.where("doc_id = 7 and extra.k = 1").groupBy("copies").count().collect()}
    assert sum(counts.values()) == 3001 and abs(counts[2] - 900) <= 2
    again = mixing.mix(frame.repartition(9), total=1.3)
    key = lambda df: Counter((r["doc_id"], r["extra"]["k"], r["copies"]) for r in df.collect())
    assert key(found) == key(again) and found.count() == 3501


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, repeated = Counter(runs), set(), set(), 0
    for i, run in enumerate(runs):
        covered |= {i, i + 1, i + 2} if often[run] > 1 else set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_quality_rules(spark, sf_dir):
    texts = ["", None, "  \n\t", "a b c a b c", "x\nx\n \n \nx ", "é ü & <b>", "w " * 30_000, " ".join(f"v{i}" for i in range(90)), "***$$$ " * 60]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t, [None, "en", "zz"][i % 3], True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept boolean")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, repeated, covered = base_counts(t)
        assert tuple(rows[i][c] for c in quality_rules.COUNTS) == (n, chars, symbols, repeated, covered)
        assert rows[i]["base_failed"] == (n < 50 or 100 * covered > 50 * n)
        assert not (rows[i]["kept"] and rows[i]["base_failed"])
    assert quality_rules.quality_rules(frame.limit(0)).count() == 0


def test_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a)
    array = lambda x: F.array(*[F.lit(v) for v in x])
    found = spark.range(1).select(quality_rules.jensen_shannon(array(p), array(q)), quality_rules.jensen_shannon(array([1.0, 0.0]), array([0.0, 1.0]))).first()
    assert math.isclose(found[0], math.sqrt((kl(p) + kl(q)) / 2)) and found[1] == 1.0


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", F.lit(1))
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = cut_lineage(docs)
        counts.append(docs.count())
    assert counts[0] > 150 and counts[1] <= counts[0] and counts[2] == counts[1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    whole = pieces.groupBy().agg(F.sum("length")).first()[0]
    assert whole > 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "plain words", None, None, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, sf_dir).collect()
    kept = corpus_pipeline.near_dedup(spark, odd, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None"]


def test_near_dedup_keeps_texts_that_share_a_key(spark, sf_dir):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = text("a") + " tail"
    rows = [(7, text("a"), "x"), (7, text("b"), "x"), (7, text("b"), "w"), (7, text("c"), "x"), (7, None, "x"), (7, "", "x"), (3, text("d"), "x"), (9, near, "x"), (8, text("c"), "x"), (2, text("c"), "x"), (11, text("e"), "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = Counter([(7, text("a"), "x"), (7, text("b"), "w"), (7, None, "x"), (7, "", "x"), (3, text("d"), "x"), (2, text("c"), "x"), (11, text("e"), "x")])
    for frame in (docs, docs.repartition(5)):
        kept = corpus_pipeline.near_dedup(spark, frame, sf_dir)
        assert kept.columns == docs.columns
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in kept.collect()) == told


def test_run_packs_whole_documents(spark, sf_dir):
    """Each document that the pipeline keeps is packed whole, once for each of its copies."""
    pieces = corpus_pipeline.run(spark, sf_dir)
    held = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("copies")).collect()
    keys = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert len(held) > 100 and {r["doc_id"] for r in held} <= keys
    assert all(r["n"] == r["copies"] * r["doc_tokens"] and 1 <= r["copies"] <= 2 for r in held)


def test_mix_is_near_its_targets(spark, sf_dir):
    """Each source takes what it is due to within about one of its larger documents, and copies are floor(rate) or one more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.mix(docs).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        taken, rate = sum(r["size"] * r["copies"] for r in own), own[0]["target"] / own[0]["source_size"]
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        assert {r["copies"] for r in own} <= {math.floor(rate), math.floor(rate) + 1}
        due = len(own) * (rate - math.floor(rate))
        assert abs(sum(r["copies"] - math.floor(rate) for r in own) - due) < 1 + 1e-6


def test_mix_of_a_very_long_text(spark):
    frame = spark.createDataFrame([(1, "a", "w " * 400_000), (2, "a", None), (3, "b", "x y")], "doc_id long, source string, text string")
    found = {r["doc_id"]: (r["size"], r["copies"]) for r in mixing.mix(frame).collect()}
    assert found[1][0] == 400_000 and found[2][0] == 0 and found[3] == (2, 2)


def test_pipeline_first_stage_on_odd_and_empty_tables(spark, sf_dir):
    """The classifier's stage keeps the columns, scores null and empty texts, and takes null keys, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(30).unionByName(docs.limit(30)).unionByName(docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit("w " * 300_000)}))
    kept = corpus_pipeline.quality(spark, odd.withColumn("score", F.lit("mine")), sf_dir)
    assert kept.columns == [*docs.columns, "score"] and {r["score"] for r in kept.select("score").collect()} <= {"mine"}
    times = Counter(r["doc_id"] for r in kept.where("doc_id >= 0").collect())
    assert set(times.values()) <= {2} and times
    assert corpus_pipeline.quality(spark, docs.limit(0), sf_dir).count() == 0


def test_dates_of_the_whole_calendar_are_permuted(spark):
    """Days outside 1900 to 2100 get days outside of it, one to one, in all four forms; days that don't exist stay."""
    first = datetime.date(1900, 1, 1)
    inside = {(first + datetime.timedelta(n)).isoformat() for n in range(pii.DAYS_LEFT * pii.DAYS_RIGHT)}
    outside = [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), first - datetime.timedelta(1), first + datetime.timedelta(len(inside))]
    outside += [datetime.date(1650, 1, 1) + datetime.timedelta(37 * n) for n in range(1_500)] + [datetime.date(2150, 1, 1) + datetime.timedelta(911 * n) for n in range(2_000)]
    for form in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", "%d/%m/%Y"):
        own = sorted({d for d in outside if form != "%d/%m/%Y" or d.day > 12})
        told = [f"{d.year:04d}".join(d.strftime(form.replace("%Y", "@")).split("@")) for d in own]
        rows = spark.createDataFrame([(t,) for t in told], "d string").select(pii._date(F.col("d"), KEY)).collect()
        found = [r[0] for r in rows]
        assert len(set(found)) == len(told) and sum(a == b for a, b in zip(found, told)) <= 2
        back = {datetime.datetime.strptime(x, form).date() for x in found}
        assert not {d.isoformat() for d in back} & inside and (form != "%d/%m/%Y" or min(d.day for d in back) > 12)
    assert moved(spark, "0000-01-01", "1899-02-29", "2101-13-01") == ["0000-01-01", "1899-02-29", "2101-13-01"]


def test_social_numbers_against_a_plain_permutation(spark):
    """The pseudonym's place among all valid numbers is the permuted place of the number."""
    for text in ("001-01-0001", "899-99-9999", "665-50-1234", "667-01-0001", "123-45-6789"):
        area, group, serial = map(int, text.split("-"))
        place = (area - 2 if area > 666 else area - 1) * 989901 + (group - 1) * 9999 + serial - 1
        left, right = brute_pair(*divmod(place, 989901), 898, 989901, "social")
        to = left * 989901 + right
        new_place, rest = divmod(to, 989901)
        assert moved(spark, text) == [f"{new_place + 2 if new_place >= 665 else new_place + 1:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"]
