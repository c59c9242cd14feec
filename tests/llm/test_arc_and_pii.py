import base64
import gzip
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronolith.llm import arc, pii

from .fixtures import documents


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_records_are_taken_by_declared_length(version):
    blocks = [("http://a/", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\n\nhttp://fake 1 2 text/html 3\n"), ("dns:a", b"1.2.3.4\n"), ("http://empty/", b"")]
    data = arc.make_arc(version, "f.arc", blocks)
    got = list(arc.parse_arc(data))
    assert [(r.version, r.fields["url"], r.block) for r in got] == [(version, u, b) for u, b in blocks]
    assert list(arc.parse_arc(arc.make_arc(version, "f.arc", []))) == []
    with pytest.raises(ValueError, match="declares"):
        list(arc.parse_arc(data[: data.index(b"1.2.3.4") + 3]))
    with pytest.raises(ValueError, match="version block"):
        list(arc.parse_arc(data[data.index(b"http://a/") :]))
    with pytest.raises(ValueError, match="not known"):
        list(arc.parse_arc(data.replace(b"\n%s 0 archive" % version.encode(), b"\n9 0 archive")))


def test_warc_records():
    http, plain = (next(iter(arc.parse_arc(arc.make_arc("1", "f", [(u, b)])))) for u, b in (("http://a/", b"HTTP/1.0 200 OK\n\nhi"), ("dns:a", b"1.2.3.4")))
    lines, block = arc.convert(http)
    fields, back = next(arc.parse_warc([lines, arc.END + block, arc.END]))
    assert (fields["WARC-Type"], fields["WARC-Date"], back) == ("response", "1997-01-01T00:00:00Z", http.block)
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and arc.convert(http)[0] == lines
    assert arc.convert(plain)[0].count(b"WARC-Type: resource") == 1
    revisit, block = arc.convert(http, "7")
    assert b"WARC-Type: revisit" in revisit and block == b"HTTP/1.0 200 OK\n\n" and arc.record_id("7", arc.digest(b"hi")).encode() in revisit
    with pytest.raises(ValueError):
        list(arc.parse_warc([lines + arc.END + b"short"]))
    both = gzip.compress(b"abc" * 1000) + gzip.compress(b"") + gzip.compress(b"de")
    assert b"".join(arc.unzipped(both, 7)) == b"abc" * 1000 + b"de"
    with pytest.raises(ValueError, match="cut off"):
        list(arc.unzipped(both[:-9]))


def test_pages_to_archives_and_back(spark, tmp_path):
    rows = [(5, "http://x/ä b", "<p>same</p>"), (3, "http://y/", "<p>same</p>"), (3, "http://z/", "<p>same</p>"), (3, "http://q/", "own"), (9, None, None), (10, "", ""), (None, "http://n/", "<p>same</p>"), (None, "u", "lonely"), (11, "http://l/", "é\r\n\r\nWARC/1.1\r\n" * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(3)
    got = arc.archive_pages(pages).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same) if same else i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert "http://x/%C3%A4%20b" in {r["url"] for r in got} and "about:blank" in {r["url"] for r in got}
    assert arc.archive_pages(pages.where("false")).count() == 0


def test_every_record_is_a_gzip_member_and_files_are_rolled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arc, "FILE_ARCS", 2)
    monkeypatch.setattr(arc, "ARC_BYTES", 1000)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://p/").alias("url"), F.concat(F.lit("é"), F.repeat(F.col("id").cast("string"), 300)).alias("html"))
    path = f"file://{tmp_path}/warc"
    arc.to_warc(pages.coalesce(1), path)
    files, records = sorted((tmp_path / "warc").glob("*.warc.gz")), 0
    assert len(files) > 1 and not list((tmp_path / "warc").glob("*.txt"))
    for file in files:
        data = file.read_bytes()
        while data:
            member = zlib.decompressobj(wbits=31)
            record, data = member.decompress(data), member.unused_data
            assert member.eof
            if record:
                assert len(list(arc.parse_warc([record]))) == 1
                records += 1
        assert gzip.decompress(file.read_bytes()).endswith(arc.END)
    got = arc.read_warc(spark, path).collect()
    assert records == len(got) == 40 and {(r["page_id"], r["payload_bytes"]) for r in got} == {(i, 2 + 300 * len(str(i))) for i in range(40)}


def test_a_page_of_50_mb(spark):
    pages = spark.range(2).select(F.col("id").alias("page_id"), F.lit("http://big/").alias("url"), F.repeat(F.lit("<p>long</p>"), 5_000_000).alias("html"))
    got = arc.archive_pages(pages).collect()
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in sorted(got, key=lambda r: r["page_id"])] == [(0, "response", None, 55_000_000), (1, "revisit", 0, 55_000_000)]


def test_archives_in_a_folder_are_converted(spark, tmp_path):
    good = arc.make_arc("2", "one.arc", [("http://a/b c", b"HTTP/1.1 200 OK\r\n\r\nbody"), ("dns:a", b"1.2.3.4\n")])
    (tmp_path / "one.arc").write_bytes(good)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(arc.make_arc("1", "two.arc", [("http://z/", b"x" * 100_000)])))
    (tmp_path / "cut.arc").write_bytes(good[:-6])
    (tmp_path / "none.arc").write_bytes(b"no archive\n")
    (tmp_path / "odd.arc").write_bytes(good.replace(b" 19970101000000 text/html", b" yesterday text/html", 1))
    (tmp_path / "other.txt").write_bytes(good)
    got = arc.convert_arcs(spark, str(tmp_path)).collect()
    by = lambda name: [r for r in got if r["path"].endswith("/" + name)]
    assert [(r["record_type"], r["url"], r["error"]) for r in by("one.arc")] == [("warcinfo", "filedesc://one.arc", None), ("response", "http://a/b c", None), ("resource", "dns:a", None)]
    fields, block = next(arc.parse_warc([bytes(by("one.arc")[1]["record"])]))
    assert (fields["WARC-Target-URI"], block) == ("http://a/b%20c", b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert [r["record_type"] for r in by("two.arc.gz")] == ["warcinfo", "resource"] and not by("other.txt")
    assert [r["error"] is None for r in by("cut.arc")] == [True, True, False] and "declares" in by("cut.arc")[2]["error"]
    assert "version block" in by("none.arc")[0]["error"] and "yesterday" in by("odd.arc")[-1]["error"]


KEY = b"k"


def test_surrogates_keep_type_format_gender_and_script():
    text = 'Mrs. Anna Müller, MR JOHN DOE and Dr. Иван Петров: Anna.B@x.org, +49 (030) 123-4567, 4111 1111 1111 1111, 078-05-1120, 10.0.0.7, 8.8.8.8, DE89 3704 0044 0532 0130 00, token = "abcDEF123"; at 12:30 on 2026-01-02, 3.14'
    new, kinds = pii.replace(text, KEY)
    assert sorted(kinds) == ["card", "email", "iban", "ip", "ip", "person", "person", "person", "phone", "secret", "ssn"]
    shape = lambda t: re.sub(r"\d+(?=[.,])", "n", re.sub(r"\d", "0", t))
    assert shape(new[new.index("+49") : new.index(", token")]) == shape(text[text.index("+49") : text.index(", token")])
    assert new.endswith("at 12:30 on 2026-01-02, 3.14") and "+49 (" in new and ", 10." in new
    assert all(x not in new for x in ("Anna", "Müller", "JOHN", "Иван", "123-4567", "4111", "078-05", "8.8.8.8", "3704", "abcDEF123"))
    first = re.match(r"Mrs\. (\w+) (\w+), MR ([A-Z]+) ([A-Z]+) and Dr\. ([А-я]+) ([А-я]+):", new)
    assert first and first[1][0].isupper() and first[1].endswith("a")
    assert pii._luhn(re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")) == 0
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_mentions_of_one_entity_agree_and_keys_differ():
    one, two = pii.replace("a +1 (017) 555-7713 b", KEY)[0], pii.replace("c +1 017 555-7713.", KEY)[0]
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(one) == digits(two) != "10175557713"
    assert pii.replace("X@Y.org x@y.org", KEY)[0].lower().split()[0] == pii.replace("x@y.org", KEY)[0]
    assert pii.replace("x@y.org", KEY) != pii.replace("x@y.org", b"other")
    assert pii.replace("", KEY) == ("", []) and pii.replace("clean text, no data.", KEY) == ("clean text, no data.", [])


def test_permutation_without_fixed_points():
    for n in (2, 3, 10, 26, 257, 1000):
        seen = [pii.moved(pii._tag(KEY, "f"), n, x) for x in range(n)]
        assert sorted(seen) == list(range(n)) and all(x != y for x, y in enumerate(seen))
    one, two = pii._tag(KEY, "f"), pii._tag(b"o", "f")
    assert pii.moved(one, 1, 0) == 0 and [pii.moved(one, 1000, x) for x in range(9)] != [pii.moved(two, 1000, x) for x in range(9)]
    assert pii.moved(one, 128**pii.BLOCK, 5) < 128**pii.BLOCK and len(pii.surrogate(KEY, "secret", "aZ1!" * 5000)) == 20000


def test_full_formats_have_distinct_surrogates(spark):
    """All of a private network, all mailboxes of one letter, numbers with and without checksum: no two share a surrogate."""
    rng = __import__("random").Random(3)
    nets = [f"192.168.{a}.{b}" for a in (0, 1, 255) for b in range(256)]
    cards = ["4" + "".join(rng.choice("0123456789") for _ in range(15)) for _ in range(300)]
    names = [f"{g}|{n}" for n in ("anna lee", "bob", "иван", "o-ke du") for g in "mfn"]
    known = {"ip": [*nets, "10.0.0.1", "8.8.8.8", "0.1.2.3"], "email": [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"], "card": cards, "person": names}
    known |= {"ssn": ["078051120", "000000000", "666121234"], "phone": [f"1|555{k:03d}" for k in range(300)] + [f"|555{k:03d}" for k in range(300)], "iban": [f"DE{k:02d}370400440532013000" for k in range(100)], "secret": ["a" * 31 + "1", "1" * 31 + "a", "pass-Word", "abcdef12"]}
    rows = [(1, kind, x) for kind, some in known.items() for x in some]
    got = pii.assign(spark.createDataFrame([*rows, *rows], "print long, type string, canonical string"), KEY).collect()
    made = {(r["type"], r["canonical"]): r["surrogate"] for r in got}
    assert len(got) == len(made) == len(rows) == len({(k, v) for (k, _), v in made.items()})
    assert all(v != x for (_, x), v in made.items())
    assert all(made["ip", x].startswith("192.168.") for x in nets) and made["ip", "10.0.0.1"].startswith("10.")
    assert all((pii._luhn(x) == 0) == (pii._luhn(made["card", x]) == 0) and made["card", x][0] == "4" for x in cards)
    valid = lambda x: x[2:4] == pii._check_digits(x[:2], x[4:])
    assert sum(valid(x) for x in known["iban"]) == 1 and all(valid(x) == valid(made["iban", x]) for x in known["iban"])
    assert all(made["person", x][:2] == x[:2] for x in names)


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a1" * 500_000, "a." * 500_000 + "@", "@" * 300_000, "1.1" * 200_000, "x@" * 200_000, "a_" * 300_000 + "@b.org"):
        pii.replace(text, KEY)
    assert time.perf_counter() - began < 30
    assert [m[2] for m in pii.mentions("_.bob@x.org, a@b, c_@d.org, \"x@y.zz@q.org\" and 8.8.8.8")] == ["email", "email", "ip"]


def test_surrogates_equal_brute_force(spark):
    """Every mention planted at a known place is replaced by its entity's surrogate, and nothing else changes."""
    rng = __import__("random").Random(6)
    planted = {"email": ["x.y@ab.org", "Z1@q-r.com"], "ip": ["10.1.2.3", "9.8.7.6"], "ssn": ["078-05-1120"], "card": ["4111 1111 1111 1111"]}
    rows, want = [], {}
    for i in range(60):
        parts, new = [], []
        for _ in range(rng.randint(0, 5)):
            kind = rng.choice(list(planted))
            text = rng.choice(planted[kind])
            parts += [rng.choice(["word", "Ünder", "数据"]), text]
            new += [parts[-2], pii.render(kind, text, pii.surrogate(KEY, kind, pii.canonical(kind, text)))]
        rows.append((i, " ".join([*parts, "end"]), "kept", "_t"))
        want[i] = " ".join([*new, "end"])
    docs = spark.createDataFrame([*rows, *rows, (100, None, None, None), (101, "", "x", "y")], "doc_id long, text string, row string, _text string").withColumn("others", F.lit(1))
    out = pii.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "n_entities", "kinds"]
    got = out.collect()
    assert all(r["text"] == want[r["doc_id"]] and (r["row"], r["_text"], r["others"]) == ("kept", "_t", 1) for r in got if r["doc_id"] < 100) and len(got) == 122
    assert {(r["text"], r["n_entities"]) for r in got if r["doc_id"] >= 100} == {(None, 0), ("", 0)}


def test_clean_and_empty_tables(spark):
    docs = documents(spark)
    out = pii.pseudonymise(docs, KEY)
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert pii.pseudonymise(docs.where("false"), KEY).count() == 0


def test_texts_without_digit_or_sign_and_other_scripts_digits():
    for line, secret in (('password = "correct-horse"', "correct-horse"), ('token="abcdefghijk"', "abcdefghijk")):
        assert pii.replace(line, KEY)[1] == ["secret"] and secret not in pii.replace(line, KEY)[0]
    arabic = "078-05-1120".translate({ord("0") + k: 0x660 + k for k in range(10)})
    new, kinds = pii.replace(f"x {arabic} y", KEY)
    assert kinds == ["ssn"] and arabic not in new and re.fullmatch("x [\u0660-\u0669]{3}-[\u0660-\u0669]{2}-[\u0660-\u0669]{4} y", new)
    plain = re.sub("[\u0660-\u0669]", lambda m: str(ord(m[0]) - 0x660), new)
    assert plain == pii.replace("x 078-05-1120 y", KEY)[0]


def test_persons_keep_one_surrogate_in_all_forms(spark):
    text = "Dr Smith met Mr John Smith. John Smith left; Smith, SMITH and Mr Smith stayed with Dr John Smith. Smithson and smith stay."
    new, kinds = pii.replace(text, KEY)
    got = re.fullmatch(r"Dr (\w+) met Mr (\w+) (\w+)\. (\w+) (\w+) left; (\w+), (\w+) and Mr (\w+) stayed with Dr (\w+) (\w+)\. Smithson and smith stay\.", new)
    assert got and kinds == ["person"] * 7 and not re.search(r"\b(?:John|Smith|SMITH)\b", new)
    assert len({got[k].lower() for k in (1, 3, 5, 6, 7, 8, 10)}) == 1 and got[2] == got[4] == got[9] and got[7].isupper()
    two = pii.replace("Mr Tom Gray and Mrs Ann Gray: Mrs Gray spoke, Mr Gray did not.", KEY)[0]
    names = re.fullmatch(r"Mr \w+ (\w+) and Mrs \w+ (\w+): Mrs (\w+) spoke, Mr (\w+) did not\.", two)
    assert names and names[1] == names[4] and names[2] == names[3]
    docs = spark.createDataFrame([(1, "so Dr John Smith said"), (2, "so Mr John Smith said"), (3, "so John Smith said")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, KEY).collect()}
    assert out[1].replace("Dr ", "Mr ") == out[2] != "so Mr John Smith said" and out[3] == "so John Smith said"


#: Texts with what must go from each, written down by hand.
FORMS = [
    ('password = "!@#$%^&*" end', ["!@#$%^&*"]),
    ('secret="--------"', ["--------"]),
    ("token='''''''''' key = \"😀😀😀😀😀😀😀😀\"", ["😀😀😀😀😀😀😀😀"]),
    ("token: abcdefgh12345, and on", ["abcdefgh12345"]),
    ("Password='it-is-long' ok", ["it-is-long"]),
    ("API_KEY: \"abcd-efgh-ijkl\"", ["abcd-efgh-ijkl"]),
    ("Mr J. Smith came; Smith left", ["Smith"]),
    ("Mr. O'Brien and Mrs. D’Arcy", ["O'Brien", "D’Arcy"]),
    ("call 2125550187 now", ["2125550187"]),
    ("paid by 3782 822463 10005.", ["3782 822463 10005"]),
    ("from 2001:db8:85a3::8a2e:370:7334 to 2001:0db8:0000:0000:0000:ff00:0042:8329", ["2001:db8:85a3::8a2e:370:7334", "2001:0db8:0000:0000:0000:ff00:0042:8329"]),
    ("at fe80::1 only", ["fe80::1"]),
]


def test_forms_that_must_not_stay():
    for text, gone in FORMS:
        new, kinds = pii.replace(text, b"k")
        assert len(kinds) >= len(gone) and not any(x in new for x in gone), (text, new)
        assert pii.replace(text, b"k")[0] == new != pii.replace(text, b"other")[0]


def test_what_looks_alike_stays():
    for text in ("at 12:30:45 on 1767225600", "key: the-third-of-them", "std::vector a::b", "monkey: banana", "00:1b:44:11:3a:b7", "The token is gone. Keys: many", "Plan J. Smith"):
        assert pii.replace(text, b"k") == (text, [])


def test_secrets_of_signs_have_distinct_surrogates(spark):
    rows = [(f'password = "{a}{b}######"',) for a in "!#$%&()*+" for b in ",-./:;<=>?"]
    out = pii.pseudonymise(spark.createDataFrame(rows, "text string"), b"k").collect()
    assert len({r["text"] for r in out}) == len(rows) and not {r["text"] for r in out} & {r[0] for r in rows[:1]}


def test_an_entity_without_another_form_is_an_error(spark):
    found = spark.createDataFrame([("secret", '""""""""')], "type string, canonical string")
    with pytest.raises(ValueError, match="no other form"):
        pii.assign(found, b"k")
