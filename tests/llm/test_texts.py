"""Surrogates, URL filter, chat format, resharding and the pipeline."""

import itertools
import os
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from shelfmark.llm import chat_format, reshard, surrogates, url_automaton
from shelfmark.llm.common import settle, shared_dir, workspace

PII = (
    "Mr. John Smith met Frau Müller and Mr. John Smith. Call +1 (663) 555-6869 or +1-663-555-6869; 4111 1111 1111 1111, 4111111111111111. "
    "a.b@mail2.example.com A.B@MAIL2.EXAMPLE.COM. Госпожа Иванова. DE89 3704 0044 0532 0130 00 SSN 123-45-6789 ip 10.0.0.1. token = \"11acdfb36bb72224148e6160f674b4be45601bff\""
)


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kind string, pos int")


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark):
    clean = "A clean text of 2024 with 1234567890123456 and version 1.2.3, 50% more."
    rows = [(1, PII), (2, PII + " again"), (3, clean), (4, None), (5, ""), (6, "x@y.org"), (6, "x@y.org")]
    out = surrogates.pseudonymise(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "kind", "pos", "__n_entities"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[3] == [clean] and got[4] == [None] and got[5] == [""] and len(got[6]) == 2 and got[6][0] == got[6][1] != "x@y.org"
    text = got[1][0]
    assert got[2][0] == text + " again"  # coreference
    for secret in ("John", "Smith", "Müller", "555-6869", "4111", "a.b@mail2", "Иванова", "3704", "123-45-6789", "10.0.0.1", "11acdf"):
        assert secret not in text
    m = re.fullmatch(
        r"Mr\. (\w+ \w+) met Frau (\w+) and Mr\. \1\. Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-\3-\4-\5; (\d{4}) (\d{4}) (\d{4}) (\d{4}), \6\7\8\9\. "
        r"(\w\.\w@\w{4}\d\.example\.com) ([A-Z]\.[A-Z]@[A-Z]{4}\d\.EXAMPLE\.COM)\. Госпожа ([А-Я][а-я]+)\. DE\d\d(?: \d{4}){4} \d\d SSN \d{3}-\d\d-\d{4} ip (?:\d{1,3}\.){3}\d{1,3}\. token = \"[0-9a-f]{40}\"",
        text,
    )
    assert m, text
    assert luhn("".join(m.group(6, 7, 8, 9))) and m[10].upper() == m[11] and m[2].endswith("na") and m[12].endswith("на") and not m[1].split()[0].endswith("na")


def test_phones_end_before_other_numbers(spark):
    """A phone is the same entity whatever number follows it, and the other number is found or left alone."""
    alone = ["+1 (826) 555-4081", "+1 (843) 555-7672", "190.137.223.204", "170.106.47.218", "+49 30 901820", "4111 1111 1111 1111"]
    both = ["+1 (826) 555-4081 190.137.223.204", "+1 (843) 555-7672 170.106.47.218", "+1 (826) 555-4081 2024", "+49 30 901820 4111 1111 1111 1111", "+49 30 901820 10.0.0.1"]
    whole = ["+33 1 23 45 67 89", "+44 20 7946 0958", "+86 138 1234 5678", "+18265554081", "+1 (826) 555-4081-2024"]
    out = {r["doc_id"]: r for r in surrogates.op5_surrogates(spark, docs(spark, list(enumerate(alone + both + whole)))).collect()}
    new = {t: out[k]["text"] for k, t in enumerate(alone + both + whole)}
    assert all(new[t] != t for t in alone)
    assert new[both[0]] == f"{new[alone[0]]} {new[alone[2]]}" and new[both[1]] == f"{new[alone[1]]} {new[alone[3]]}"
    assert new[both[2]] == f"{new[alone[0]]} 2024" and new[both[3]] == f"{new[alone[4]]} {new[alone[5]]}"
    assert new[both[4]].startswith(f"{new[alone[4]]} ") and "10.0.0.1" not in new[both[4]]
    assert [r["n_entities"] for _, r in sorted(out.items())] == [1] * 6 + [2, 2, 1, 2, 2] + [1] * 5
    for t in whole:  # all digits but the first are drawn anew
        assert re.sub("[0-9]", "0", new[t]) == re.sub("[0-9]", "0", t) and sum(a != b for a, b in zip(t, new[t], strict=True)) >= 5


def test_surrogates_stay_distinct(spark):
    """SSNs of one digit's difference; two-character mail names collide often and are drawn again."""
    values = [f"{a}{b}@m.org" for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)]
    entities = spark.createDataFrame([("email", v) for v in values], "kind string, value string")
    table = surrogates.distinct_surrogates(entities).collect()
    assert len({r["replacement"] for r in table}) == len(values) and not {r["replacement"] for r in table} & set(values)
    other = surrogates.distinct_surrogates(entities.limit(20), key="another").collect()
    same = {r["value"]: r["replacement"] for r in table}
    assert any(same[r["value"]] != r["replacement"] for r in other)


def kind_by_hand(surface):
    kind = next(k for k, p in surrogates.KINDS.items() if regex.fullmatch(p, surface))
    if (kind == "card" and not luhn(re.sub("[^0-9]", "", surface))) or (kind == "iban" and mod97(surface.replace(" ", "")) != 1):
        return None
    return kind


def value_by_hand(kind, surface):
    if kind in ("card", "ssn", "phone"):
        digits = re.sub("[^0-9]", "", surface)
        return digits[1:] if kind == "phone" and surface.startswith("+1") and len(digits) == 11 else digits
    if kind == "name":
        return ("f " if regex.match(surrogates.FEMALE, surface) else "m ") + surface.split(" ", 1)[1].lower()
    return {"iban": surface.replace(" ", ""), "email": surface.lower()}.get(kind, surface)


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


PLANTED = [  # text, what must be gone from it, what must stay; written without a look at the patterns
    ("Mrs. Smith-Jones rang.", ["Smith", "Jones"], ["Mrs. ", " rang."]),
    ("Mr. McDonald, then Mr. O'Brien and Mr. O’Neill-Smythe.", ["Donald", "Brien", "Neill", "Smythe"], [", then Mr. ", " and Mr. "]),
    ("Herr Müller-Lüdenscheidt sah Frau Groß.", ["Müller", "denscheidt", "Groß"], ["Herr ", " sah Frau "]),
    ("MR. SMITH AND MRS. JOHN DOE", ["SMITH", "DOE"], ["MR. ", " AND MRS. "]),
    ("Dr. Watson, Prof. Moriarty, Mme Curie, Miss Marple, el Sr. García, la Sra. Ruiz.", ["Watson", "Moriarty", "Curie", "Marple", "García", "Ruiz"], ["Dr. ", "Prof. ", "Mme ", "Miss ", "el Sr. ", "la Sra. "]),
    ("Boris M. Bell and John Smith Sr. He left.", [], ["Boris M. Bell and John Smith Sr. He left."]),
    ("AT61 1904 3002 3457 3201 EUR now", ["1904", "3201"], ["AT", " EUR now"]),
    ("to NO93 8601 1117 947.", ["8601", "947"], ["to NO", "."]),
    ("AB12 CDEF GHIJ KLMN OPQR and DE89 3704 0044 0532 0130 01", [], ["AB12 CDEF GHIJ KLMN OPQR and DE89 3704 0044 0532 0130 01"]),
    ("+1 (826) 555-4081 or (826) 555-4081 or 826-555-4081", ["555-4081"], ["+1 ("]),
    ("key " + "0123456789abcdef" * 12, ["0123456789abcdef"], ["key "]),
]


def test_planted_entities(spark):
    out = {r["doc_id"]: r["text"] for r in surrogates.op5_surrogates(spark, docs(spark, [(k, t) for k, (t, _, _) in enumerate(PLANTED)])).collect()}
    for k, (text, gone, stays) in enumerate(PLANTED):
        assert not [g for g in gone if g in out[k]], (text, out[k])
        assert not [s for s in stays if s not in out[k]], (text, out[k])
    first, second, third = (re.sub("[^0-9]", "", p) for p in out[9].split(" or "))
    assert first == "1" + second == "1" + third
    assert len(out[10]) == len(PLANTED[10][0]) and re.fullmatch(r"MR\. [A-Z]+ AND MRS\. [A-Z]+ [A-Z]+", out[3])


def test_one_entity_in_many_forms(spark):
    """An IBAN before a word, with and without blanks, and a hyphenated name beside its first half."""
    texts = ["AT61 1904 3002 3457 3201 EUR", "AT611904300234573201", "Mrs. Smith", "Mrs. Smith-Jones", "MRS. SMITH"]
    out = [r["text"] for r in surrogates.op5_surrogates(spark, docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert out[0].replace(" ", "") == out[1] + "EUR" and mod97(out[1]) == 1
    assert out[4] == "MRS. " + out[2].split(" ")[1].upper() and out[3].split(" ")[1] != out[2].split(" ")[1]


def test_surrogates_against_brute_force(spark, sf_dir):
    """Every text: nothing but its entities changes, one entity has one replacement everywhere, none is an entity of the corpus."""
    made = [(1_000_000, PII), (1_000_001, PII + " Herr Smith and Monsieur Smith saw Mrs. Smith. GB82 WEST 1234 5698 7654 32"), (None, PII), (None, None), (1_000_002, "Mr. Smith " * 3000), (1_000_002, "Mr. Smith " * 3000)]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).distinct()
    before = [(r["doc_id"], r["text"]) for r in table.collect()]
    out = {}
    for r in surrogates.op5_surrogates(spark, table).collect():
        out.setdefault(r["doc_id"], []).append(r)
    of, real, kinds = {}, set(), set()
    for doc_id, text in before:
        if text is None:
            assert any(r["text"] is None for r in out[doc_id])
            continue
        found = [(m.group(), kind_by_hand(m.group())) for m in regex.finditer(surrogates.ANY_KIND, text)]
        gaps, at = [], 0
        for m in regex.finditer(surrogates.ANY_KIND, text):
            gaps.append(text[at : m.start()])
            at = m.end()
        gaps.append(text[at:])
        pattern = regex.escape(gaps[0], special_only=True)
        for (surface, kind), gap in zip(found, gaps[1:], strict=True):
            form = {"email": r"\S+?", "ip": "[0-9.]+", "name": " ".join([r"\S+"] * len(surface.split(" "))), None: regex.escape(surface, special_only=True)}.get(kind, f".{{{len(surface)}}}")
            pattern += (f"({form})" if kind else form) + regex.escape(gap, special_only=True)
        entities = [(s, k) for s, k in found if k]
        hits = [(r, m) for r in out[doc_id] if r["text"] is not None and (m := regex.fullmatch(pattern, r["text"], regex.S))]
        assert hits and hits[0][0]["n_entities"] == len(entities), doc_id
        for (surface, kind), new in zip(entities, hits[0][1].groups(), strict=True):
            value, fresh = value_by_hand(kind, surface), value_by_hand(kind, new)
            assert of.setdefault((kind, value), fresh) == fresh
            real.add((kind, value))
            kinds.add(kind)
            if kind in ("card", "phone", "ssn", "iban"):
                assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", surface))
            if kind == "card":
                assert luhn(fresh)
            if kind == "iban":
                assert mod97(fresh) == 1 and fresh[:2] == value[:2]
    assert len(set((k, v) for (k, _), v in of.items())) == len(of) and not real & {(k, v) for (k, _), v in of.items()}
    assert {"email", "phone", "ip", "card", "iban", "name", "ssn", "secret"} <= kinds


def test_a_full_format_does_not_run_out(spark):
    """All addresses of one letter at domains of one letter."""
    entities = spark.createDataFrame([("email", f"{a}@{b}.com") for a, b in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2)], "kind string, value string")
    table = surrogates.distinct_surrogates(entities).collect()
    assert len(table) == 676 == len({r["replacement"] for r in table})


def test_no_surrogate_is_a_name_of_the_corpus(spark):
    """The name first drawn for one entity stands in the corpus under several titles."""
    one = spark.createDataFrame([("name", "mr. smith", 0)], "kind string, value string, attempt int")
    drawn = surrogates.draw(one, surrogates.KEY).first()["replacement"]
    names = ["mr. smith", f"mr. {drawn}", f"herr {drawn}"]
    table = {r["value"]: r["replacement"] for r in surrogates.distinct_surrogates(one.select("kind", "value").unionByName(spark.createDataFrame([("name", n) for n in names[1:]], "kind string, value string"))).collect()}
    assert sorted(table) == sorted(names) and len(set(table.values())) == 3 and not set(table.values()) & {"smith", drawn}


def test_surrogates_of_nothing(spark):
    assert surrogates.op5_surrogates(spark, docs(spark, [(1, "x")]).where("false")).count() == 0
    assert surrogates.op5_surrogates(spark, docs(spark, [(1, "no entity")])).collect()[0]["n_entities"] == 0


def as_regex(glob):
    out = re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.compile(out, re.S)


def test_automaton_against_regular_expressions():
    rnd = random.Random(2)
    globs = ["*a/**", "**b", "?a*", "*.ab/*", "", "*", "a" * 70 + "**", "**ab**ba**", "a?/b"]
    texts = ["".join(rnd.choice("ab./") for _ in range(rnd.randint(0, 12))) for _ in range(1500)] + ["a" * 200, "", "a" * 69]
    got = url_automaton.ShiftAnd(globs).match([t.encode() for t in texts])
    for k, g in enumerate(globs):
        r = as_regex(g)
        assert got[:, k].tolist() == [bool(r.fullmatch(t)) for t in texts]


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.NET/en/x?y#z", "http://example.net/EN/", "http://net/", "http://planet/x", "ftp://a.org/fr/#", "http://x.com?/de/", "http://é.com/ü"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, None, "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_automaton.op7_url_filter(spark, pages).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "/EN/", "net/", "block") and got[6][2] == "net/" and got[7][2] is None
    assert got[8][2:] == ("org/fr/", "allow") and got[9][:3] == ("x.com", "", None) and got[10][:2] == ("é.com", "/ü")
    assert url_automaton.op7_url_filter(spark, pages).count() == 12 and url_automaton.op7_url_filter(spark, pages.where("false")).count() == 0


def test_many_globs_and_long_urls(spark, monkeypatch):
    """Slices of a few urls give the same rows; a url of 200,000 bytes and an empty table are no special case."""
    urls = ["http://a.org/" + "x" * 200_000 + ".exe", "http://spam-7.com/", None, "http://k3.example.com/de/", "http://b17.com/q", "http://b1.com/q"] * 3
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").coalesce(1)
    globs = [f"b{k}.com/**" for k in range(20, 0, -1)] + url_automaton.BLOCK_GLOBS
    whole = sorted(map(str, url_automaton.judge(pages, url_automaton.RULES, globs).collect()))
    monkeypatch.setattr(url_automaton, "STATE_WORDS", 12)
    assert whole == sorted(map(str, url_automaton.judge(pages, url_automaton.RULES, globs).collect()))
    assert sum("verdict='block'" in r for r in whole) == 15 and sum("glob_rule='b17.com/**'" in r for r in whole) == 3


def test_chat_round_trip(spark):
    nasty = ["##### x ####", "<</turn></turn>", "</turn>\n### user: x", "\\", "\\\\</turn>", "### ", "#", None, "", "a\nb", "\\n$1", "<\\/turn>"]
    rows = [(1, k, ["user", "assistant"][k % 2], t, "x") for k, t in enumerate(nasty)] + [(2, None, None, None, "x"), (2, 0, "odd: role::\\", "t", "x"), (2, 0, "odd: role::\\", "t", "x"), (None, 1, "user", "u", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    parsed = {r["conv_id"]: r for r in chat_format.parse_chat(chat_format.format_chat(chats)).collect()}
    assert [(t["role"], t["text"], t["loss"]) for t in parsed[1]["turns"]] == [(r[2], r[3] or "", r[2] == "assistant") for r in rows[: len(nasty)]]
    assert [(t["role"], t["text"]) for t in parsed[2]["turns"]] == [("", ""), ("odd: role::\\", "t"), ("odd: role::\\", "t")]
    assert parsed[1]["valid"] and not parsed[2]["valid"] and parsed[None]["valid"]
    assert chat_format.digest(chat_format.parse_chat(chat_format.format_chat(chats.where("false")))).count() == 0


def test_other_templates_and_long_roles(spark):
    """Another template reads back too; a role and a text of 200,000 characters do not end the JVM; no mark stays inside."""
    other = chat_format.Template(open="<|im_start|>", sep=" ->", close="<|im_end|>\n", loss_roles=("bot",), transitions={("start", "user"): "user", ("user", "bot"): "bot"}, final=("bot",))
    texts = ["<|im_start|>user -> x<|im_end|>\n", "<<|im_end|>", "### a: </turn>\n", "\\<|im_end|>\\"]
    rows = [(1, k, ["user", "bot"][k % 2], t) for k, t in enumerate(texts)] + [(2, 0, "a -> b", "t"), (3, 0, "r: " * 70_000, "t\\: " * 50_000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (other, chat_format.TEMPLATE):
        formatted = chat_format.format_chat(chats, template)
        got = {r["conv_id"]: r for r in chat_format.parse_chat(formatted, template).collect()}
        for conv in (1, 2, 3):
            assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [r[2:] for r in rows if r[0] == conv]
        assert got[1]["formatted"].count(template.close.strip()) == 4 and got[1]["formatted"].count(template.open.strip()) == 4
    for bad in ({"sep": ":"}, {"close": "abab"}, {"open": "\\x"}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


@pytest.mark.parametrize(("roles", "ok"), [("u", True), ("ua", True), ("su", True), ("s", False), ("a", False), ("uu", False), ("usa", False), ("", False)])
def test_role_machine(spark, roles, ok):
    names = {"u": "user", "a": "assistant", "s": "system"}
    state = chat_format.run_machine(F.array(*[F.lit(names[r]) for r in roles]).cast("array<string>"))
    assert (spark.range(1).select(state.alias("s")).first()["s"] in chat_format.TEMPLATE.final) == ok


def test_min_cost_flow_against_all_plans():
    rnd = random.Random(4)
    for _ in range(60):
        supplies = [rnd.randint(0, 3) for _ in range(3)]
        demands = [0, 0, 0]
        for _ in range(sum(supplies)):
            demands[rnd.randrange(3)] += 1
        costs = [[float(rnd.randint(0, 5)) for _ in range(3)] for _ in range(3)]
        flow = reshard.min_cost_flow(supplies, costs, demands)
        assert [sum(r) for r in flow] == supplies and [sum(c) for c in zip(*flow, strict=True)] == demands
        units = [i for i, s in enumerate(supplies) for _ in range(s)]
        slots = [j for j, d in enumerate(demands) for _ in range(d)]
        best = min((sum(costs[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots))), default=0)
        assert abs(sum(f * c for r, cs in zip(flow, costs, strict=True) for f, c in zip(r, cs, strict=True)) - best) < 1e-6


def test_shards(spark, sf_dir):
    out = reshard.op10_reshard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    counts = {}
    for r in out:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(counts) == list(range(16)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())


def test_shards_of_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, "x" * 300000, "a"), (None, "y", "b")]
    some = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, slot int")
    out = reshard.op10_reshard(spark, some).collect()
    assert len(out) == 5 and sorted(r["shard"] for r in out) == [0, 1, 2, 3, 4] and {r["slot"] for r in out} == {0}
    assert {r["size"] for r in out if r["doc_id"] in (1, 2)} == {1} and {r["text_crc32"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert reshard.op10_reshard(spark, some.where("false")).count() == 0


@pytest.mark.parametrize("bucket", [250_000, 7])
def test_moves_are_as_few_as_can_be(spark, bucket):
    """Rows and bytes moved against the exact optimum: of each overfull shard the smallest rows leave."""
    rnd = random.Random(6)
    rows = [(k, rnd.choice([1, 5, 17, 18, 19, 20, 1000, 1001]), rnd.choice([0, 0, 0, 1, 2, 3, 9])) for k in range(400)] + [(7, 1, 0)] * 60
    table = spark.createDataFrame(rows, "id long, size long, old int")
    out = reshard.reshard(table, 6, bucket).collect()
    assert sorted((r["id"], r["size"], r["old"]) for r in out) == sorted(rows)
    room = reshard.capacities(len(rows), 6)
    for s in range(6):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(room[s]))
    best = 0
    for old in {r[2] for r in rows}:
        held = sorted(r[1] for r in rows if r[2] == old)
        best += sum(held[: max(0, len(held) - (room[old] if old < 6 else 0))])
    assert sum(r["size"] for r in out if r["old"] != r["shard"]) == best


def test_rewritten_shards_hold_all_rows_once(spark, tmp_path):
    """Null and repeated ids; shard 0 is emptied, shard 3 is not touched and stays in its files."""
    path = str(tmp_path / "shards")
    rows = [(None, "a", "s", 0), (None, "b", "s", 0), (1, "c", None, 0), (1, "c", None, 1), (1, None, "s", 1), (2, "d", "s", 3), (2, "d", "s", 3)]
    first = spark.createDataFrame([((*r[:3], 7), r[3], r[3]) for r in rows], "document struct<doc_id: long, text: string, source: string, shard: int>, old_shard int, shard int")
    reshard.write_shards(first, path, 0)
    moved = first.withColumn("shard", F.when(F.col("old_shard") == 0, 1).otherwise(F.col("old_shard")))
    reshard.write_shards(moved, path, 1, base=0)
    for version, want in ((0, first), (1, moved)):
        got = reshard.read_shards(spark, path, version)
        assert sorted(map(str, got.select("document", "shard").collect())) == sorted(map(str, want.select("document", "shard").collect()))
    assert {r["shard"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v1").collect()} == {1: 1, 3: 0}
    documents = spark.createDataFrame([(*r[:3], 7) for r in rows], "doc_id long, text string, source string, shard int")
    placed = reshard.place_documents(documents, 4)
    reshard.write_shards(placed, path, 2)
    back = reshard.read_shards(spark, path, 2)
    assert sorted(map(str, back.select("document.*").collect())) == sorted(map(str, documents.collect()))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [1, 2, 2, 2]


def test_stages_keep_odd_rows_and_columns(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, an empty table, and columns named like helpers."""
    import corpus_pipeline

    helpers = ["__key", "row_key", "node", "component", "__found", "__text", "c0", "key", "kept", "hits"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in helpers)
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    texts = [(1, good), (1, good), (None, good + " more"), (None, None), (None, None), (2, ""), (3, "Mail x@y.org now"), (None, "\n \t")]
    odd = spark.createDataFrame([(d, t, None, None, None, *helpers) for d, t in texts], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, odd.where("false"), sf_dir).count() == 0, name
        out = stage(spark, odd, sf_dir)
        rows = out.collect()
        if k < 4:
            assert out.columns == odd.columns and all(list(r)[5:] == helpers for r in rows), name
        if name == "near_duplicates":
            assert sorted(str(r["text"]) for r in rows) == sorted(str(t) for t in [good, None, None, "", "Mail x@y.org now", "\n \t"])
        elif k > 1:
            assert len(rows) == len(texts), name


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    from shelfmark.llm import compression_quality, suffix_pieces

    from .test_pairs import brute_groups

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = compression_quality.learn(docs, labels)
    ids = sorted(texts)
    good = [d for d, s in zip(ids, model.scores([texts[d] for d in ids]), strict=True) if s >= 0.5]
    firsts = sorted({g for _, g in brute_groups([(d, texts[d]) for d in good])})

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))

    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    banned = {(min(10, len(w)), x) for w in items if w for x in runs(w, min(10, len(w)))}
    lengths = {n for n, _ in banned}
    clean = [d for d in firsts if not any((n, x) in banned for n in lengths for x in runs(words(texts[d]), n))]
    changed = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(docs.where(F.col("doc_id").isin(clean))).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(suffix_pieces.MODEL))
    had = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    left = [x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x not in had]
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline-sentencepiece"]  # nothing else stays behind
    assert 0 < len(clean) < len(firsts) < len(good) < len(ids) and got == {d: sp.encode(changed[d]) for d in clean}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        assert k in (0, 1, 2) or set(ids) == seen
        assert k == 4 or docs.columns == columns
        seen = set(ids)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, **values):
            self.conf, self.values = self, values

        def get(self, key, default=None):
            return self.values.get(key, default)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Session(**{"spark.master": master}))
    assert shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_a_workspace_leaves_nothing(spark, tmp_path):
    with workspace():
        df = settle(spark.range(3), "kept")
        df.write.parquet(str(tmp_path / "out"))
        where = df._settled_at.removeprefix("file:")
        assert os.path.exists(where)
    assert not os.path.exists(where) and spark.read.parquet(str(tmp_path / "out")).count() == 3
