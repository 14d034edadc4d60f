import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from harborlight.llm import bpe, canonical, language, mapping, packing, residue, split, topn

EMPTY = "id long, t string"


def docs(spark, rows, schema=EMPTY):
    return spark.createDataFrame(rows, schema)


# --- 6: top N in groups


def brute_top(rows, n):
    by = {}
    for g, s, i in {r for r in rows if r[0] is not None}:
        by.setdefault(g, []).append((-s if s is not None else float("inf"), i))
    return {(g, i, k) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n], 1)}


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_top_n_with_hot_groups_ties_and_repeats(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), float(rng.randint(0, 3)), i) for i in range(800)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "g long, s double, id long").withColumn("position_", F.lit(1)).withColumn("__pos", F.lit("x")).withColumn("__PID", F.lit("y"))
    out = topn.top_n(df, ["g"], [F.col("s").desc()], ["id"], 7, partitions=parts)
    assert out.columns == [*df.columns, "position"]
    assert {(r.g, r.id, r.position) for r in out.collect()} == brute_top(rows, 7) and out.count() == len(brute_top(rows, 7))


def test_rows_that_differ_in_what_tells_them_apart_both_count(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 1), ("a", 1.0, 1), ("a", 0.5, 2)], "g string, s double, id long")
    got = [(r.s, r.id, r.position) for r in topn.top_n(df, ["g"], [F.col("s").desc()], ["s", "id"], 3).orderBy("position").collect()]
    assert got == [(2.0, 1, 1), (1.0, 1, 2), (0.5, 2, 3)]


def test_top_n_of_nothing_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "g string, s double, id long")
    assert topn.top_n(df.limit(0), ["g"], [F.col("s").desc()], ["id"], 3).count() == 0
    assert [r.position for r in topn.top_n(df, ["g"], [F.col("s").desc()], ["id"], 3).collect()] == [1]


# --- 4: splitting

TEXTS = ["a" * 250, "word " * 90, "One. Two! Three? " * 30, "p1\n\np2\n \n" * 40, "句子。" * 80, "x" * 120 + " " + "y" * 99, "​" * 130, "a b\r\n\r\nc" * 30]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(100, 10), (50, 0), (30, 29)])
def test_pieces_cover_the_text_under_the_limit(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in got)
    for (_, end, _), (start, later, _) in itertools.pairwise(got):
        assert end - overlap <= start <= end < later
    whole = text[: got[0][1]] + "".join(text[p[1] : n[1]] for p, n in itertools.pairwise(got))
    assert whole == text


def level_of(text, limit):
    level, cut = split.level_pieces(text, limit)
    assert "".join(text[a:b] for a, b, _ in cut) == text and all(len(text[a:b].strip()) <= limit for a, b, _ in cut)
    return level


def brute_level(text, limit):
    """The definition: cut at every boundary of a level and look at every piece."""
    for level in split.LEVELS:
        ends = split.Offsets(text).level(level)[0]
        if all(len(text[a:b].strip()) <= limit for a, b in itertools.pairwise([0, *ends, len(text)])):
            return level
    return "none"


def test_levels_follow_from_the_pieces_and_their_boundaries(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", ". ", "\n", "\n \n", "。", "x" * 9]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert {level_of(t, 20) for t in texts} == {"paragraph", "sentence", "word", "none"}
    assert all(level_of(t, 20) == brute_level(t, 20) for t in texts)
    monkeypatch.setattr(split.Offsets, "last", lambda *_: None)  # without the search only hard cuts are left
    assert {split.level_pieces(t, 20)[0] for t in texts if len(t.strip()) > 20} == {"none"}


def test_levels_of_boundaries():
    assert level_of("a" * 60 + "\n \t\n" + "b" * 60, 100) == "paragraph"
    assert level_of("a" * 60 + "\n" + "b" * 60, 100) == "sentence"
    assert level_of("a" * 60 + ". " + "b" * 60, 100) == "sentence"
    assert level_of("a" * 60 + ".b" + "b" * 60, 100) == "none"
    assert level_of("あ" * 60 + "。" + "い" * 60, 100) == "sentence"
    assert level_of("a" * 60 + " " + "b" * 60, 100) == "word"
    with pytest.raises(ValueError):
        split.pieces("a", 5, 5)


def test_split_texts_of_nulls_short_and_long(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "a" * 100), (4, "b" * 300_001), (None, "c" * 200)])
    out = split.split_texts(df, "id", "t", 100, 10).collect()
    assert {r.id for r in out} == {4} and max(r.end_at for r in out) == 300_001
    assert split.split_texts(df.limit(0), "id", "t").count() == 0


# --- 5: look-alikes


def test_look_alikes_pair_and_others_do_not(spark):
    same = ["Đá Sáng 5", "Đá Sáng 5​", "Ｄ".replace("Ｄ", "Đ") + "á Sáng 5", "Đá Sáng　5 ", "Ðá Sáng ５", "Đа́ Sáng 5"]
    other = ["đá sáng 5", "Da Sang 5", "Đá Sáng, 5", "Đá Sáng 6", "", "  ", "​", None, "เก", "กเ", "dừa"]
    rows = [(i, t) for i, t in enumerate(same + other + ["dừa"])] + [(100, same[0]), (100, same[0]), (None, same[0])]
    got = {(r.id_a, r.id_b) for r in canonical.look_alike_pairs(docs(spark, rows), "id", ["t"]).collect()}
    group = [*range(len(same)), 100]
    want = {(a, b) for a in group for b in group if a < b and dict(rows)[a] != dict(rows)[b]}
    assert got == want | {(len(same) + 10, len(same) + 11)}
    forms = {r.id: r.canonical for r in canonical.canonical(docs(spark, rows), "id", ["t"]).collect()}
    assert len({forms[i] for i in group}) == 1 and len(set(forms.values())) == len({unicodedata.normalize("NFC", v) for v in forms.values()})
    assert canonical.look_alike_pairs(docs(spark, []), "id", ["t"]).count() == 0


def test_canonically_equal_texts_pair_under_the_collation(spark):
    pairs = [("5 K", "5 \u212a"), ("\u00c5", "\u212b"), ("caf\u00e9", "cafe\u0301"), ("\u6a02", "\uf914"), ("\u0928\u093c", "\u0929"), ("\u05e9\u05c1", "\ufb2a")]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {(r.id_a, r.id_b) for r in canonical.look_alike_pairs(docs(spark, rows), "id", ["t"]).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
    forms = {r.id: (r.canonical_id, r.canonical) for r in canonical.canonical(docs(spark, rows), "id", ["t"]).collect()}
    assert all(forms[a] == forms[b] for a, b in got)
    keys = canonical._keys(docs(spark, rows), "id", ["t"]).collect()
    look, exact = {r.id: r.look for r in keys}, {r.id: r.exact for r in keys}
    assert all(look[a] == look[b] for a, b in got) and len(set(look.values())) == len(pairs)
    assert all(exact[i] == 0 for i in range(8))  # the collation alone decides here


def test_without_the_collation_pairs_are_lost(spark, monkeypatch):
    rows = [(1, "5 K"), (2, "5 \u212a"), (3, "ho\u200btel"), (4, "hotel"), (5, "\u6a02"), (6, "\uf914")]
    assert canonical.look_alike_pairs(docs(spark, rows), "id", ["t"]).count() == 3
    monkeypatch.setattr(canonical, "_collation_key", lambda text: text)
    assert canonical.look_alike_pairs(docs(spark, rows), "id", ["t"]).count() == 0


def test_what_the_collation_confuses_is_told_apart(spark):
    apart = ["12", "١٢", "①②", "x²", "x2", "เก", "กเ", "𝐀", "𝐴", "👨\u200d👩", "👨👩", "Ⅳ", "IV"]
    assert canonical.look_alike_pairs(docs(spark, list(enumerate(apart))), "id", ["t"]).count() == 0
    same = [("ﬁn", "fin"), ("ｶﾞ", "ガ"), ("Ⅹ", "X"), ("Ꮇ", "M"), ("a\u200b \u200bb", "a b"), ("\u200b x", "x"), ("1\ufe0f", "1")]
    rows = [(2 * i + j, t) for i, p in enumerate(same) for j, t in enumerate(p)]
    assert {(r.id_a, r.id_b) for r in canonical.look_alike_pairs(docs(spark, rows), "id", ["t"]).collect()} == {(2 * i, 2 * i + 1) for i in range(len(same))}


def test_the_collation_errs_for_no_sure_character(spark):
    every = [c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x30000))) if unicodedata.category(c) not in ("Cn", "Co")]
    pairs = [(c, m) for c in every if not canonical._APART.search(c) and not canonical._UNSURE.search(m := c.translate(canonical._TWINS))]
    key = F.xxhash64(canonical._collation_key(F.concat(F.lit("a"), "m", F.lit("b"))))
    sure = spark.createDataFrame(pairs, "t string, m string").select("t", "m", key.alias("k")).collect()
    by = {}
    for r in sure:
        if r.m.strip() and unicodedata.category(r.m) not in ("Cc", "Cf"):
            by.setdefault(r.k, set()).add(unicodedata.normalize("NFC", r.m))
    assert len(sure) > 80_000 and all(len(v) == 1 for v in by.values())
    ignored = {r.k for r in sure if r.m and unicodedata.category(r.m) in ("Cc", "Cf") and not r.m.isspace()}
    assert len(ignored) == 1 and not ignored & set(by)


def test_canonically_equal_characters_are_composed_or_sure(spark):
    changed = [(c, unicodedata.normalize("NFC", c)) for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.normalize("NFC", c) != c and c not in canonical.SPACES]
    assert [c for c, n in changed if not canonical._APART.search(c) and (canonical._UNSURE.search(c) or canonical._UNSURE.search(n))] == []


def test_plain_texts_need_no_mapping(spark):
    plain = [c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x30000))) if not re.search("[^\\t-\\r\\x20-\\x7e\u00c0-\u00cf\u00d1-\u00e5\u00e7-\u00ef\u00f1-\u0126\u0128-\u017e\u01a0-\u01b0\u1e00-\u1eff\u2013-\u201f\u2026]", c)]
    assert docs(spark, [(ord(c), c) for c in plain]).where(F.col("t").rlike(canonical._PLAIN)).count() == 0
    assert [c for c in plain if not c.isspace() and (canonical.final_form(canonical.map_text(c)) != c or canonical._UNSURE.search(c))] == []


# --- 7: mapping

ENTRIES = [("C1", ["Trà Dương", "Tra Duong", "TP. Trà Dương"]), ("C2", ["Vân Rồng Dương", "Van Rong Duong"]), ("C3", ["Thanh Khê"])]


@pytest.mark.parametrize(
    ("value", "entry"),
    [("tra duong", "C1"), (" TRÀ  DƯƠNG ", "C1"), ("Thành phố Trà Dương", "C1"), ("Trà Dương (Vân Bửu)", "C1"), ("Tỉnh Vân Rồng Dương, Thanh Khê", "C3"), ("Tra Duog", "C1"), ("Vân Rồn Dương", "C2"), ("Trà Dương City", "C1"), ("khách sạn ở Trà Dương", "C1"), ("nhà nghỉ gần tra duong", "C1"), ("ks ven biển Trà Dương", "C1"), ("Khê Thanh", "C3")]
    + [(v, mapping.NONE) for v in ("Lam Hoài Dương", "-", "???", "1", "N/A", "Trà Dương Thượng Hạ", "trà dương thượng hạ", "Linh Trà Dương", "x" * 20_000)],
)
def test_cities(value, entry):
    assert mapping.decide([mapping.Mapper(ENTRIES)], "city", value) == entry


def test_map_values_reports_every_value(spark):
    concepts = spark.createDataFrame([("A", "amenity", "Hồ bơi", "Pool", ["Bể bơi"]), ("B", "amenity", "Nhà hàng", None, None)], "concept_id string, facet string, label_vi string, label_en string, surface_forms array<string>")
    values = spark.createDataFrame([(1, "amenity", "a", p, v) for p, v in enumerate(["Hồ bơi", None, " ", "có hồ bơi", "be boi *", "Nha hang", "lạ lùng", "Hồ bơi"])], "id long, facet string, field string, pos int, value string")
    got = {(r.pos, r.concept_id) for r in mapping.map_values(values, concepts).collect()}
    assert got == {(3, "A"), (4, "A"), (5, "B"), (6, mapping.NONE)}
    assert mapping.map_values(values, concepts.limit(0)).count() == 0 and mapping.map_values(values.limit(0), concepts).count() == 0


@pytest.mark.parametrize("value", ["tra duong", "Trà Dương Thượng Hạ", "khách sạn ở Trà Dương", "Vân Rồn Dương", "Khê Thanh", "Lam Hoài Dương", "Tỉnh Vân Rồng Dương, Thanh Khê", "-"])
def test_blocks_of_the_list_find_what_the_whole_list_finds(value):
    blocks = [mapping.Found(mapping._look(mapping.Mapper([e]), "city", value)) for e in ENTRIES]
    assert mapping.decide(blocks, "city", value) == mapping.decide([mapping.Mapper(ENTRIES)], "city", value)


def test_a_longer_list_goes_in_blocks(spark, monkeypatch):
    concepts = spark.createDataFrame([(f"C{i}", "city", f"Xóm {a}{b}", None, [f"xom so {i}"]) for i, (a, b) in enumerate(itertools.product("abcdefg", "hiklmn"))], "concept_id string, facet string, label_vi string, label_en string, surface_forms array<string>")
    values = spark.createDataFrame([(i, "city", "city", 0, v) for i, v in enumerate(["xom ah", "ở Xóm gn", "XOM SO 7", "xom so 41 ", "Xóm ah", "lạ", None, "Làng Xóm bk Cả"])], "id long, facet string, field string, pos int, value string")
    got = sorted(mapping.map_values(values, concepts).collect())
    monkeypatch.setattr(mapping, "MOST_FORMS", 20)
    assert sorted(mapping.map_values(values, concepts).collect()) == got and {r.id: r.concept_id for r in got} == {0: "C0", 1: "C41", 2: "C7", 3: "C41", 5: mapping.NONE, 7: mapping.NONE}


def test_without_the_automaton_mentions_are_lost(monkeypatch):
    monkeypatch.setattr(mapping.Mapper, "hits", lambda *_: [])
    assert mapping.decide([mapping.Mapper(ENTRIES)], "city", "khách sạn ở Trà Dương") == mapping.NONE


# --- 8: encoding


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_library(spark, library):
    rng = random.Random(5)
    texts = ["", None, " ", "aaaa" * 500, " " * 777 + "x", "<|endoftext|> is text", "Đườnǵ đi 😀👨‍👩‍👧", "\r\n\t", "don't we'll", "ก็" * 200, "\x00\x01"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xC0, 0x24F), rng.randint(0x4E00, 0x4FFF), 32])) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    df = docs(spark, list(enumerate(texts))).withColumn("key", F.lit("clash"))
    got = {r.id: r.ids for r in bpe.encode(df, "id", "t").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (library.encode(t, add_special_tokens=False).ids if t else [])
    assert {r.id: r.n_tokens for r in bpe.token_counts(df, "id", "t").collect()} == {i: len(v) for i, v in got.items()}
    assert bpe.encode(df.limit(0), "id", "t").count() == 0


def test_blocks_and_forgetting_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 5)
    monkeypatch.setattr(bpe, "KEPT", 3)
    e = bpe.Encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for t in ["one two three", "three four", "one two three"]:
        assert [i for w in e.encode([t])[0] for i in w] == library.encode(t).ids


# --- 9: packing


def brute_bins(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    import numpy as np

    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        best = brute_bins(sizes, 20)
        bins, used = packing.best_fit_decreasing(np.array(sizes), 20)
        assert packing.lower_bound(np.array(sizes), 20) <= best <= used
        assert max(np.bincount(bins, sizes)) <= 20


def test_packing_is_whole_and_near_the_bound(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.randint(1, 99), 100, 0, 250, 333])) for i in range(3_000)] + [(3_001, None), (None, 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100, bucket_items=200).collect()
    by, fill = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.part, r.start_token, r.n_tokens))
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    for i, n in rows:
        if i is not None and n:
            parts = sorted(by[i])
            assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(-(-n // 100))) and all(p[1] == p[0] * 100 for p in parts)
        elif i is not None:
            assert i not in by
    assert max(fill.values()) <= 100 and len(fill) <= sum(fill.values()) / 100 * 1.02 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


# --- 10: residue


@pytest.mark.parametrize("text", ["Welcome to {{ name }}, dear", "Giá từ ${price} mỗi đêm", "Tên phòng: null.", "Dear %s, hello", "to [insert name here] now", "at <%= x %> we", "Kính gửi None, đơn", "from __check_in__ on", "%CITY% is nice", "{{#if a}}", "[object Object]", "a TBD_NAME b", "chào mừng đến với undefined.", "NONE LIEGT AM MARKT"])
def test_slots_left_raw_or_empty(text):
    assert residue.has_slot(text)


@pytest.mark.parametrize("text", ["None of us needed the heater.", "almost undefined, so", "hòa null-null", "a page titled <hello> in gold", "Bức tranh tên là {im lặng}", "Giảm 20% số đêm", "Wifi tên là __tang_tret__ thôi", "[Deluxe] và [Standard]", "in chữ %HE25% ở góc", "<|endoftext|> <unk> </s>", "durante todo el día", "I <3 it, $5 & 10%", "mặt cười :cuoi: vẽ tay", "todo el dia con el mar"])
def test_signs_in_real_content(text):
    assert not residue.has_slot(text)


def test_pages_and_content(spark):
    host = "h"
    real = "Bữa sáng ngon và phòng sạch sẽ, sẽ quay lại."
    rows = [
        (1, host, "404 Not Found"), (2, host, "Nhà A — Giới thiệu\n404 Not Found\nNav chính\nMã 99"), (3, host, "Service temporarily unavailable\nNav chính\nMã 12"), (4, host, "Seite nicht gefunden\nNav chính\nMã 7"),
        (5, host, f"{real}\n404 Not Found"), (6, host, real), (7, host, None), (8, host, " \n"), (9, host, "Please enable JavaScript to continue."), (10, host, "We met at a JavaScript meetup held in the meeting room."),
        (11, host, "Lorem ipsum dolor sit amet. Purus quis vitae nunc."), (12, None, "ACCESS DENIED. REFERENCE 66A3497B16"), (13, host, f"{real} " * 3_000), (1, host, "404 Not Found"), (None, host, "404 Not Found"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit(1))
    got = {(r.doc_id, r.reason) for r in residue.find_residue(df, "doc_id", "source", "text").collect()}
    assert got == {(i, "page") for i in (1, 2, 3, 4, 9, 11, 12)}
    assert residue.find_residue(df.limit(0), "doc_id", "source", "text").count() == 0


WORDINGS = """The requested URL was not found on this server.|You must enable JavaScript to view this page.|500 Internal Server Error|Checking your browser before accessing the site.|Content goes here.|HTTP Error 503. The service is unavailable.|Access to this page has been denied.|Please turn JavaScript on and reload the page.
This site is currently undergoing scheduled maintenance. Please check back shortly.|Error establishing a database connection|You don't have permission to access this page.|Insert your text here|Your session has expired. Please log in again.|Whoops, looks like something went wrong.|Trang bạn yêu cầu không tồn tại.|Website đang được bảo trì, vui lòng quay lại sau ít phút.
Bạn cần bật JavaScript để sử dụng trang web này.|Nội dung đang được cập nhật|Cette page n'existe plus.|Die angeforderte Seite existiert nicht.|La página solicitada no existe|Página não encontrada|Halaman yang Anda cari tidak ada|Ошибка 404. Страница не существует|서버 점검 중입니다|現在メンテナンス中です|抱歉，您访问的页面不存在|ไม่พบหน้าที่คุณต้องการ|java.lang.NullPointerException: x"""


def test_wordings_of_notices_and_sentences_that_mention_them():
    notices = WORDINGS.replace("\n", "|").split("|")
    assert [t for t in notices if not residue.is_page(residue.fold(t), ())] == []
    told = ["Phòng 404 nằm cuối hành lang, cửa hơi kẹt.", "Lúc đặt phòng trang web báo lỗi 500 nhưng gọi điện thì nhân viên xử lý rất nhanh.", "Our server was out of mangoes, an internal joke by the second day.", "The pool was under maintenance during our stay.", "The sign at the door said Access Denied, we laughed.", "Quán Lorem ở tầng trệt pha cà phê khá đậm.", "Internet temporarily unavailable on floor 3 but staff helped us quickly.", "rất rất rất đẹp"]
    assert [t for t in told if residue.is_page(residue.fold(t), ())] == []


@pytest.mark.parametrize("most", [200_000, 0])
def test_the_counts_of_lines_by_host_decide(spark, monkeypatch, most):
    monkeypatch.setattr(residue, "MOST_KNOWN", most)
    menu, real = "Suites Dining Spa Gallery", "Breakfast by the river was lovely."
    rows = [(i, "h", f"404 Not Found\n{menu}") for i in range(4)] + [(10, "h", f"{menu} Seite nicht gefunden"), (11, "other", f"Seite nicht gefunden\n{menu}"), (12, "h", f"{real}\nSeite nicht gefunden"), (13, "h", menu), (14, None, real)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = lambda **k: {r.doc_id for r in residue.find_residue(df, "doc_id", "source", "text", **k).collect()}
    assert found() == {0, 1, 2, 3, 10} and found(recurrent=6) == set()


@pytest.mark.parametrize("most", [200_000, 0])
def test_the_way_of_looking_boilerplate_up_changes_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(residue, "MOST_KNOWN", most)
    menu, learned, real = "Salon open to every single guest today.", "Error on the river path page", "Breakfast by the river was lovely."
    rows = [(i, "a", f"404 Not Found\n{menu}") for i in range(3)]
    rows += [(10 + i, "a", learned) for i in range(3)] + [(13, "b", learned)]  # learned from one host, met in another
    rows += [(20, "a", f"404 Not Found\n{menu}\n{real}"), (20, "b", f"404 Not Found\n{menu}")]  # an id in two hosts, boilerplate in one
    rows += [(30 + i, host, "ページが見つかりません。ホテル桜の湯") for i, host in enumerate("ab")]  # cut within a word, with and without boilerplate
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id for r in residue.find_residue(df, "doc_id", "source", "text").collect()} == {0, 1, 2, 10, 11, 12, 13, 30, 31}


def test_sentences_are_cut_alike_whatever_boilerplate_there_is():
    known = {residue._hash("nav # bar")}
    for line, rest in [("ページ。ホーム", ["ページ。", "ホーム"]), ("nav 7 bar ページ。ホーム. x y", ["ページ。", "ホーム.", "x y"]), ("a b. c。nav 8 bar", ["a b.", "c。", "nav 8 bar"])]:
        assert [u.strip() for u in residue.residual(line, known) if u.strip()] == rest
    assert [*residue.residual("a b. c。d", ())] == [*residue.residual("a b. c。d", known)] == ["a b. ", "c。", "d"]


# --- 1: languages

SAMPLE = {
    "vi": ["Quý khách đến đây sẽ thấy ngay sân thượng ở tầng {}", "Bữa sáng được phục vụ từ {} giờ tại hồ bơi", "Tường được sơn màu đất và ít đồ trang trí {}"],
    "en": ["Breakfast is served from {} in the garden", "The family has welcomed travellers for {} years", "Walls are painted in earth tones {}"],
    "fr": ["Le petit déjeuner est servi dès {} heures près du sauna", "Notre équipe vous accueille la nuit {}", "Le tarif comprend les taxes {}"],
    "ru": ["Завтрак подают с {} часов рядом с садом", "Наши сотрудники дежурят ночью {}", "В цену входят налоги {}"],
    "ja": ["朝食は{}時から食堂でお出しします", "料金には税金が含まれています{}", "静かな雰囲気なのでご家族に向いています{}"],
    "th": ["อาหารเช้าเริ่มเวลา {} นาฬิกาใกล้สระ", "พนักงานของเราอยู่ตลอดคืน {}", "ราคานี้รวมภาษีแล้ว {}"],
}


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    rows = []
    for k in range(700):
        lang = rng.choice([*SAMPLE])
        label = rng.choice([*SAMPLE]) if rng.random() < 0.1 else lang  # some labels are wrong
        rows.append((". ".join(rng.choice(SAMPLE[lang]).format(rng.randint(1, 99)) for _ in range(3)) + ".", label))
    return language.train(rows)


def test_held_out_sentences(net):
    rng = random.Random(9)
    truth = [(lang, s.format(rng.randint(100, 999))) for lang, ss in SAMPLE.items() for s in ss for _ in range(4)]
    k, p = net.classify([language.clean(s) for _, s in truth])
    assert sum(language.LANGUAGES[i] == lang for i, (lang, _) in zip(k, truth)) >= 0.95 * len(truth)
    assert ((p > 0) & (p <= 1)).all()


def test_segments_of_mixed_unmarked_and_wordless_texts(spark, net):
    vi, en, ja, th = (SAMPLE[k][0].format(7) for k in ("vi", "en", "ja", "th"))
    rows = [(1, f"{vi}. {vi}. / {en}. | {ja}。", "vi"), (2, language.plain_vietnamese(vi.lower()), "en"), (3, "★★★ 24/7 +++", "vi"), (4, None, "vi"), (5, " ​ ", None), (6, en.upper() + ".", "EN-us"), (7, f"{th} {en}. {vi}.", None), (8, (vi + ". ") * 2_000, "vi")]
    df = spark.createDataFrame(rows, "id long, t string, l string").withColumn("lang", F.lit("clash"))
    out = {}
    for r in language.identify(df, "id", "t", "l", net).orderBy("id", "seg").collect():
        assert 0 <= r.confidence <= 1
        out.setdefault(r.id, []).append(r.lang)
    assert out == {1: ["vi", "en", "ja"], 2: ["vi"], 3: ["und"], 6: ["en"], 7: ["th", "en", "vi"], 8: ["vi"]}
    assert language.identify(df.limit(0), "id", "t", "l", net).count() == 0
    assert re.match(language._LABEL.replace("(?i)", ""), "vi-VN", re.I)


def test_training_on_nothing_still_classifies():
    assert len(language.train([]).classify(["abc"])[0]) == 1
