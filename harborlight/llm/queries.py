"""The queries of this subpackage and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, canonical, language, mapping, packing, residue, split, topn

QUERIES: dict[str, Callable] = {
    "p1_found": language.p1_found,
    "p1_segments": language.p1_segments,
    "p4_found": split.p4_found,
    "p4_pieces": split.p4_pieces,
    "p5_found": canonical.p5_found,
    "p5_canonical": canonical.p5_canonical,
    "p6_found": topn.p6_found,
    "p7_found": mapping.p7_found,
    "p8_ids": bpe.p8_ids,
    "p9_containers": packing.p9_containers,
    "p9_quality": packing.p9_quality,
    "p10_found": residue.p10_found,
    "p10_clean": residue.p10_clean,
}

_P6 = """
WITH r AS (SELECT DISTINCT id, hotel_id, review_score FROM rooms WHERE review_score IS NOT NULL AND hotel_id IS NOT NULL),
h AS (SELECT DISTINCT id, accommodation_type, review_score FROM hotels WHERE review_score IS NOT NULL AND accommodation_type IS NOT NULL),
a AS (SELECT 'room' AS kind, CAST(hotel_id AS VARCHAR) AS group_key, id AS item_id,
             row_number() OVER (PARTITION BY hotel_id ORDER BY review_score DESC, id) AS n FROM r),
b AS (SELECT 'hotel' AS kind, accommodation_type AS group_key, id AS item_id,
             row_number() OVER (PARTITION BY accommodation_type ORDER BY review_score DESC, id) AS n FROM h)
SELECT kind, group_key, item_id FROM a WHERE n <= 3
UNION ALL SELECT kind, group_key, item_id FROM b WHERE n <= 10
"""

_P4 = r"""
WITH t AS (SELECT DISTINCT id, description AS d FROM hotels WHERE length(description) > 1000),
c AS (SELECT id,
  list_max(list_transform(regexp_split_to_array(d, '(\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])([^\S\n\r]*(\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]))+'),
    lambda x: length(regexp_replace(regexp_replace(x, '^[\s\x{a0}\x{85}\p{Z}]+', ''), '[\s\x{a0}\x{85}\p{Z}]+$', '')))) AS p,
  list_max(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(d, '([.!?…])([\s\x{a0}\x{85}\p{Z}])', '\1' || chr(1) || '\2', 'g'), '([。！？]+)', '\1' || chr(1), 'g'), '[\x{01}\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'),
    lambda x: length(regexp_replace(regexp_replace(x, '^[\s\x{a0}\x{85}\p{Z}]+', ''), '[\s\x{a0}\x{85}\p{Z}]+$', '')))) AS s,
  list_max(list_transform(regexp_split_to_array(d, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda x: length(x))) AS w
  FROM t)
SELECT DISTINCT id AS hotel_id,
  CASE WHEN p <= 1000 THEN 'paragraph' WHEN s <= 1000 THEN 'sentence' WHEN w <= 1000 THEN 'word' ELSE 'none' END AS boundary
FROM c
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p5() -> str:
    """The look-alike key in SQL: hidden characters out, letters mapped, composed, white space as one space."""
    hidden = r"[\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{115f}\x{1160}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{feff}\x{ffa0}\x{fe00}-\x{fe0f}]"
    # Fixed values, written down for the SQL alone: Cyrillic, Greek and other letters beside what they look like; signs of the
    # full-width block lie 0xFEE0 above theirs.
    letters = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ЁË ЇÏ ёë їï ӐĂ ӑă ЀÈ ѐè ӖĔ ӗĕ"
    letters += " ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ὸò ÐĐ ƉĐ ‐- ‑-"
    pairs = letters.split() + [chr(c) + chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)] + [chr(c) + " " for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    key = f"trim(regexp_replace(nfc_normalize(translate(regexp_replace(v, '{hidden}', '', 'g'), {_quoted(''.join(p[0] for p in pairs))}, {_quoted(''.join(p[1] for p in pairs))})), '[\\s\\x{{1c}}-\\x{{1f}}]+', ' ', 'g'))"
    return f"""
WITH v AS (SELECT DISTINCT id, 'name' AS field, name AS v FROM hotels WHERE name IS NOT NULL
           UNION SELECT DISTINCT id, 'description', description FROM hotels WHERE description IS NOT NULL),
k AS (SELECT id, field, v, {key} AS look FROM v)
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field = b.field AND a.look = b.look AND a.id < b.id
WHERE a.v <> b.v AND a.look <> ''
"""


ORACLE: dict[str, str] = {"p4_found": _P4, "p5_found": _p5(), "p6_found": _P6}
