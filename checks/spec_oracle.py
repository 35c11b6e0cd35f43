"""Specification parsing as plain SQL for the comparison engine, written from the rules.

No lookaround exists there and its word boundary knows ASCII only, so words are delimited by
character classes instead.
"""

from __future__ import annotations

from ductlake import fixed_values as fv

_NW = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word(pattern: str) -> str:
    return f"(^|{_NW}){pattern}({_NW}|$)"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def first_of(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {q(pattern)}, {group}), '')"


def num(expr: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({expr}, {q(pattern)}, {group}) AS DOUBLE)"


def ptype_case(expr: str) -> str:
    whens = [f"WHEN regexp_matches({expr}, {q(fv.AGGREGATE_FITTINGS_PATTERN)}) THEN 'aggregate_fittings'"]
    for literal, pattern, ptype in fv.PRODUCT_TYPES:
        p = word(literal) if pattern.endswith(r"\b") else (f"(^|{_NW})" + literal if pattern.startswith(r"\b") else literal)
        whens.append(f"WHEN regexp_matches({expr}, {q(p)}) THEN '{ptype}'")
    return "CASE " + " ".join(whens) + " END"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def canon(expr: str) -> str:
    """x spelling and digit gaps; two passes close every gap."""
    step = f"translate({expr}, 'х×*', 'xxx')"
    for _ in range(2):
        step = rf"regexp_replace({step}, '([0-9])\s+([0-9])', '\1\2', 'g')"
    return step


def size_token(expr: str) -> str:
    c = canon(expr)
    side = r"[0-9]{2,5}"
    three = rf"(?i)(?:^|{_NW})({side}\s*x\s*{side}\s*x\s*{side})(?:{_NW}|$)"
    two = rf"(?i)(?:^|{_NW})({side}\s*x\s*{side}(?:\s*[-_]\s*{side})?)(?:{_NW}|$)"
    circ = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_.])((?:DN|D|Ф|Ø|⌀)\s*{side}(?:\s*[-_]\s*{side})?)"
    prefixed = rf"regexp_replace(translate({first_of(c, circ)}, 'Ø⌀', 'ФФ'), '^(?i:dn|d)({_NW})', 'ф\1')"
    return f"replace(coalesce({first_of(c, three)}, {first_of(c, two)}, {prefixed}, ''), ' ', '')"


RECT_PRODUCT = (
    "CASE WHEN contains(nl, 'кругл') THEN false WHEN contains(nl, 'прямоугольн') THEN true "
    f"ELSE {contains_any('nl', fv.RECTANGULAR_PRODUCT_WORDS)} END"
)


def thickness() -> str:
    n = r"([0-9]{1,2}(?:\.[0-9]{1,3})?)"
    t = "translate(nl, 'ё,', 'е.')"
    t = rf"regexp_replace({t}, '\b[0-9]{{2,5}}\s*[xх×*]\s*[0-9]{{2,5}}(?:\s*[-_]\s*[0-9]{{2,5}})?\b', ' ', 'g')"
    t = rf"regexp_replace({t}, '(^|{_NW})(?:d|dn|ф)\s*[0-9]{{2,5}}(?:\s*[-_]\s*[0-9]{{2,5}})?\b', '\1 ', 'g')"

    def ranged(e: str) -> str:
        return f"CASE WHEN {e} BETWEEN 0.3 AND 3.0 THEN {e} END"

    grade = num(t, r"(?:08пс|aisi\s*[0-9]{3}|ст\.?3|ст-3)[()\s]*" + n + r"(?:[^\p{L}\p{N}_]|$)")
    mm = num(t, n + r"\s*мм")
    loose = (
        f"list_filter(list_transform(regexp_extract_all({t}, {q(n)}, 1), lambda v: TRY_CAST(v AS DOUBLE)), "
        "lambda v: v BETWEEN 0.3 AND 3.0)[1]"
    )
    return (
        "coalesce(" + num(t, r"толщин(?:а|ой)(?:\s*стенки)?\s*" + n + r"\s*мм?") + ", "
        + num(t, rf"(?:^|{_NW})[тt]\s*[=:]?\s*" + n + r"(?:[^\p{L}\p{N}_]|$)") + ", "
        + ranged(grade) + ", " + ranged(mm) + ", " + loose + ")"
    )


def features(base: str) -> str:
    """CTEs up to the classified text features; the last one is `feat`."""
    pair = r"(?i)([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    dia = r"(?i)(?:^|[^\p{L}\p{N}_.])(?:dn|d|ф|ø|⌀)\s*([0-9]{2,5})"
    qty = "TRY_CAST(replace(replace(quantity, ',', '.'), ' ', '') AS DOUBLE)"
    return f"""
base AS ({base}),
named AS (
  SELECT *, lower(name) AS nl, lower(unit) AS ul, {qty} AS qty,
    CASE WHEN size <> '' THEN size ELSE {size_token('name')} END AS size_found
  FROM base),
paired AS (
  SELECT *, {canon('size_found')} AS cs,
    TRY_CAST(regexp_extract({canon('size_found')}, {q(pair)}, 1) AS BIGINT) AS pa,
    TRY_CAST(regexp_extract({canon('size_found')}, {q(pair)}, 2) AS BIGINT) AS pb
  FROM named),
fixed AS (
  SELECT *,
    CASE WHEN ({RECT_PRODUCT}) AND (pa BETWEEN 10 AND 99 OR pb BETWEEN 10 AND 99) THEN
      replace(cs, regexp_extract(cs, {q(pair)}, 0), concat(
        CAST(CASE WHEN pa BETWEEN 10 AND 99 THEN pa * 10 ELSE pa END AS VARCHAR), 'x',
        CAST(CASE WHEN pb BETWEEN 10 AND 99 THEN pb * 10 ELSE pb END AS VARCHAR))) END AS repaired
  FROM paired),
sized AS (
  SELECT *, coalesce(repaired, size_found) AS sz,
    CASE WHEN repaired IS NOT NULL THEN
      concat('OCR: размер исправлен ''', size_found, ''' -> ''', repaired, '''') END AS ocr_warning,
    {ptype_case('nl')} AS ptype,
    CASE WHEN {contains_any("translate(nl, 'ё', 'е')", ['нерж', 'aisi'])} THEN '2'
      WHEN {contains_any("translate(nl, 'ё', 'е')", ['черн', 'ст3', 'ст.3', 'ст-3'])} THEN '3' ELSE '1' END AS code,
    {thickness()} AS named_thickness
  FROM fixed),
texts AS (
  SELECT *, concat(name, ' ', sz) AS txt, lower(concat(name, ' ', sz)) AS tl,
    translate(concat(name, ' ', sz), 'х×*', 'xxx') AS tx
  FROM sized),
tok AS (
  SELECT *,
    list_transform(regexp_extract_all(tx, {q(pair)}, 1), lambda v: TRY_CAST(v AS DOUBLE)) AS ra,
    list_transform(regexp_extract_all(tx, {q(pair)}, 2), lambda v: TRY_CAST(v AS DOUBLE)) AS rb,
    list_transform(regexp_extract_all(tx, {q(dia)}, 1), lambda v: TRY_CAST(v AS DOUBLE)) AS rd,
    CASE WHEN regexp_matches(tl, {q(f'(^|{_NW})прямоугольн')}) THEN true
      WHEN regexp_matches(tl, {q(f'(^|{_NW})кругл')}) THEN false
      ELSE regexp_matches(tl, '[0-9]{{2,4}}\\s*[xх×*]\\s*[0-9]{{2,4}}') END AS says_rect,
    CASE WHEN regexp_matches(tl, {q(f'(^|{_NW})кругл')}) THEN true
      WHEN regexp_matches(tl, {q(f'(^|{_NW})прямоугольн')}) THEN false
      ELSE regexp_matches(tl, '(?:d|dn|ф)\\s*[0-9]+') END AS says_round,
    {num('tx', r'(?i)с\s+(?:d|dn|ф)?\s*([0-9]{2,5})\s+на\s+(?:d|dn|ф)?\s*([0-9]{2,5})', 1)} AS from_d,
    {num('tx', r'(?i)с\s+(?:d|dn|ф)?\s*([0-9]{2,5})\s+на\s+(?:d|dn|ф)?\s*([0-9]{2,5})', 2)} AS to_d,
    {first_of('tx', r'(?i)LITENED\s+([0-9]{1,3}-[0-9]{1,3})\s+(?:NKD|NKK)')} AS code_key,
    upper({first_of('tx', r'(?i)LITENED\s+[0-9]{1,3}-[0-9]{1,3}\s+(NKD|NKK)')}) AS code_variant,
    coalesce({num('tx', r'(?i)(?:l\s*=?\s*|длина\s*)([0-9]{3,5})')},
      {num('tx', rf'(?i)(?:^|{_NW})([0-9]{{3,5}})\s*мм(?:{_NW}|$)')}) AS text_len,
    coalesce({num('tx', r'(?i)([0-9]{2,3})\s*°?\s*град')},
      {num('tx', rf'(?:^|{_NW})(90|45|30|60|15|75)(?:{_NW}|$)')}) AS u0,
    {num('tx', r'(?i)r\s*([0-9]{2,4})')} AS r0,
    {num('tx', rf'(?i)(?:^|{_NW})(?:MSN|KPN-S|PPK|ГЕРМИК|NKD|KNK|CHR|KCH|RV[NCS]|RSK|KON)[-\s]?([0-9]{{2,4}})(?:{_NW}|$)')} AS brand_d,
    {num('tx', r'(?i)KNK[-\s]?([0-9]{2,4})\s*/\s*([0-9])\b', 1)} AS slash_d,
    {num('tx', r'(?i)KNK[-\s]?([0-9]{2,4})\s*/\s*([0-9])\b', 2)} AS slash_l
  FROM texts),
codes(code_key, ca, cb) AS (VALUES {', '.join(f"('{k}', {a}.0, {b}.0)" for k, (a, b) in fv.MODEL_CODE_SIZES.items())}),
dims1 AS (
  SELECT tok.*, coalesce(CAST(ca AS DOUBLE), ra[1]) AS a0, coalesce(CAST(cb AS DOUBLE), rb[1]) AS b0,
    ra[2] AS a1, rb[2] AS b1, ra[3] AS a2, rb[3] AS b2,
    coalesce(to_d, CASE WHEN len(ra) < 2 AND len(rd) >= 2 THEN rd[2] END) AS d1,
    CASE WHEN len(ra) < 2 AND len(rd) >= 3 THEN rd[3] END AS d2,
    coalesce(CASE WHEN ca IS NOT NULL THEN CASE code_variant WHEN 'NKD' THEN 1100.0 WHEN 'NKK' THEN 510.0 END END, text_len) AS len0,
    coalesce(from_d, CASE WHEN len(ra) = 0 OR len(rd) = 1 THEN rd[1] END) AS d_words
  FROM tok LEFT JOIN codes USING (code_key)),
dims2 AS (
  SELECT *, coalesce(d_words, CASE WHEN a0 IS NULL THEN brand_d END) AS d_any FROM dims1),
feat AS (
  SELECT *,
    CASE WHEN slash_d IS NOT NULL AND (d_any IS NULL OR len0 IS NULL) THEN slash_d ELSE d_any END AS d0,
    CASE WHEN slash_d IS NOT NULL AND (d_any IS NULL OR len0 IS NULL) THEN slash_l * 100 ELSE len0 END AS l0
  FROM dims2)"""


def parsed(base: str) -> str:
    """CTEs up to `out`, one row per line with everything both outputs show."""
    types = ["elbow", "transition", "tee", "cross", "cap", "saddle", "flange", "silencer", "damper", "throttle", "mounting_cup"]
    trip = r"(?i)([0-9]{2,5})\s*x\s*([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    pair = r"(?i)([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    lx = "translate(tl, 'х×*', 'xxx')"
    low = "translate(lower(sz), 'х×*', 'xxx')"
    rect_size = r"^([0-9]{2,5})\s*x\s*([0-9]{2,5})(?:\s*[x_-]\s*([0-9]{2,5}))?$"
    long_size = r"^(?:d|dn|ф)\s*([0-9]{2,5})\s*[-_]\s*([0-9]{2,5})$"
    circ_size = r"^(?:d|dn|ф)?\s*([0-9]{2,5})$"
    codes = ", ".join(f"('{a}', '{','.join(codes)}')" for a, codes in fv.ARTICLE_MATERIALS.items())
    allowed = ", ".join(f"('{article}')" for article, *_ in fv.ARTICLES)

    def short(name: str) -> str:
        return f"CASE WHEN article IN {name}"

    return f"""{features(base)},
flags AS (
  SELECT *, ptype IN {in_list(types)} AS fitting,
    CASE WHEN ptype = 'silencer' AND a0 IS NOT NULL THEN true WHEN ptype = 'silencer' AND d0 IS NOT NULL THEN false ELSE says_rect END AS rect,
    CASE WHEN ptype = 'silencer' AND a0 IS NOT NULL THEN false WHEN ptype = 'silencer' AND d0 IS NOT NULL THEN true ELSE says_round END AS circ
  FROM feat),
branched AS (
  SELECT *, coalesce(nullif(coalesce(d2, d1), 0), CASE WHEN rect THEN nullif(d0, 0) END) AS branch,
    CASE WHEN contains({lx}, 'ксд') OR contains({lx}, '4апн') OR contains({lx}, 'адаптер') THEN {num(lx, pair, 1)} END AS ka,
    {num(lx, pair, 2)} AS kb, nullif({num(lx, r'(?:ксд|d|ф)\s*([0-9]{2,5})')}, 0) AS kd,
    contains(tl, 'кругл') AS kround,
    {contains_any('tl', ['прямоугольн', 'квадратн', '4апн'])} AS krect
  FROM flags),
chosen AS (
  SELECT *,
    CASE WHEN ka IS NOT NULL AND kround THEN '10-1-1' WHEN ka IS NOT NULL AND krect AND kd IS NOT NULL THEN '10-2-3' END AS adapter,
    CASE WHEN fitting AND coalesce(d0, a0, l0, u0, r0, d1, d2) IS NOT NULL THEN CASE ptype
      WHEN 'elbow' THEN CASE WHEN rect THEN
          CASE WHEN contains(nl, 'прямой') THEN '2-2-2' WHEN contains(nl, 'косой') OR regexp_matches(nl, {q(word('кос'))}) THEN '2-2-3'
            WHEN contains(nl, 'пирамид') THEN '2-2-4' ELSE '2-2-1' END
        ELSE CASE WHEN contains(nl, 'конич') THEN '2-1-2' WHEN contains(nl, 'гофрир') THEN '2-1-3' ELSE '2-1-1' END END
      WHEN 'transition' THEN CASE WHEN rect AND circ AND a0 IS NOT NULL AND d0 IS NOT NULL THEN '3-3-1' WHEN rect THEN '3-2-1' ELSE '3-1-1' END
      WHEN 'tee' THEN CASE WHEN rect THEN CASE WHEN branch IS NOT NULL THEN '4-2-1' WHEN a1 IS NOT NULL THEN '4-2-3' END
        ELSE CASE WHEN branch IS NOT NULL THEN '4-1-1' WHEN a2 IS NOT NULL THEN '4-1-3' END END
      WHEN 'cross' THEN CASE WHEN circ THEN '5-1-1' ELSE '5-2-1' END
      WHEN 'cap' THEN CASE WHEN circ THEN '6-1-1' ELSE '6-2-1' END
      WHEN 'saddle' THEN CASE WHEN circ THEN '8-1-1' ELSE '8-2-1' END
      WHEN 'flange' THEN CASE WHEN circ THEN '12-1-3' ELSE '12-2-2' END
      WHEN 'silencer' THEN CASE
        WHEN rect AND {contains_any('nl', ['пластина шумоглушителя', 'пластинчатый тип 4'])} THEN '15-2-4'
        WHEN rect AND {contains_any('nl', ['обтекатель шумоглушителя', 'с обтекателем тип 5'])} THEN '15-2-5'
        WHEN rect AND a0 IS NULL THEN NULL
        WHEN rect AND contains(nl, 'пластинчатый') THEN '15-2-2'
        WHEN rect AND contains(nl, 'с круглыми врезками') THEN '15-2-6'
        WHEN rect AND contains(nl, 'канальный') THEN '15-2-7'
        WHEN rect AND contains(nl, 'с обтекателем') THEN '15-2-3'
        WHEN rect THEN '15-2-1'
        WHEN d0 IS NULL THEN NULL
        WHEN contains(nl, 'спиральный') THEN '15-1-2' ELSE '15-1-1' END
      WHEN 'mounting_cup' THEN CASE WHEN d0 IS NOT NULL THEN '29-1-3' END
      ELSE CASE WHEN rect AND a0 IS NULL OR NOT rect AND d0 IS NULL THEN NULL
        WHEN contains(nl, 'обратный') THEN CASE WHEN rect THEN '18-2-1' ELSE '18-1-3' END
        WHEN {contains_any('nl', ['противопожарный', 'дымовой'])} THEN CASE WHEN rect THEN '20-2' ELSE '20-1' END
        WHEN contains(nl, 'воздушный') THEN CASE WHEN rect THEN '21-2-1' ELSE '21-1-1' END
        ELSE CASE WHEN rect THEN '16-2-1' ELSE '16-1-1' END END END END AS fit
  FROM branched),
routed AS (
  SELECT *, CASE WHEN qty IS NULL THEN 'bad_quantity' WHEN adapter IS NOT NULL THEN 'adapter' WHEN fit IS NOT NULL THEN 'fitting'
      WHEN ptype = 'aggregate_fittings' OR ul IN {in_list(fv.AREA_UNITS)} THEN 'aggregate' ELSE 'size' END AS route,
    regexp_matches({low}, {q(rect_size)}) AS is_rect_size,
    regexp_matches({low}, {q(long_size)}) OR regexp_matches({low}, {q(circ_size)}) AS is_circ_size,
    {num(low, rect_size, 1)} AS sa, {num(low, rect_size, 2)} AS sb,
    coalesce({num(low, long_size, 1)}, {num(low, circ_size, 1)}) AS sd,
    coalesce({num(low, rect_size, 3)}, {num(low, long_size, 2)}) AS sl,
    {num('txt', trip, 1)} AS t1, {num('txt', trip, 2)} AS t2, {num('txt', trip, 3)} AS t3,
    {num('txt', pair, 1)} AS v1, {num('txt', pair, 2)} AS v2
  FROM chosen),
measured AS (
  SELECT *, route = 'size' AND (is_rect_size OR is_circ_size) AND ul IN {in_list(fv.METRE_UNITS + fv.PIECE_UNITS)} AS duct,
    coalesce(sl, CASE WHEN is_rect_size THEN 1250.0 ELSE 3000.0 END) AS dl
  FROM routed),
articled AS (
  SELECT *, CASE WHEN route = 'adapter' THEN adapter WHEN route = 'fitting' THEN fit
      WHEN duct AND is_rect_size THEN '1-2-1' WHEN duct AND contains(nl, 'прямошовный') THEN '1-1-1' WHEN duct THEN '1-1-2' END AS article
  FROM measured),
valued AS (
  SELECT *,
    CASE WHEN article LIKE '1-1-%' THEN sd WHEN article = '10-1-1' THEN greatest(ka, kb)
      WHEN article IN ('2-1-1','2-1-2','2-1-3','3-1-1','3-3-1','4-1-1','4-1-3','5-1-1','5-2-1','6-1-1','6-2-1','12-1-3','12-2-2','8-1-1','8-2-1','15-1-1','15-1-2','29-1-3','16-1-1','18-1-3','20-1','21-1-1') THEN d0 END AS pd0,
    CASE WHEN article = '10-1-1' THEN coalesce(kd, 0) WHEN article = '10-2-3' THEN kd WHEN article IN ('3-1-1','8-1-1','8-2-1') THEN d1 END AS pd1,
    CASE WHEN article IN ('4-1-1','4-2-1') THEN branch END AS pd2,
    CASE WHEN article = '1-2-1' THEN sa WHEN article = '10-2-3' THEN ka
      WHEN article LIKE '2-2-%' OR article IN ('3-2-1','3-3-1','4-2-1','4-2-3','5-1-1','5-2-1','6-1-1','6-2-1','12-1-3','12-2-2','8-1-1','8-2-1','15-2-1','15-2-2','15-2-3','15-2-6','15-2-7','16-2-1','18-2-1','20-2','21-2-1') THEN a0 END AS pa0,
    CASE WHEN article = '1-2-1' THEN sb WHEN article = '10-2-3' THEN kb
      WHEN article = '15-2-4' THEN CASE WHEN a2 IS NULL AND t1 IS NOT NULL THEN t1 ELSE coalesce(a0, 0) END
      WHEN article = '15-2-5' THEN CASE WHEN a2 IS NULL AND t1 IS NULL AND v1 IS NOT NULL THEN v1 ELSE coalesce(a0, 0) END
      WHEN article LIKE '2-2-%' OR article IN ('3-2-1','3-3-1','4-2-1','4-2-3','5-1-1','5-2-1','6-1-1','6-2-1','12-1-3','12-2-2','8-1-1','8-2-1','15-2-1','15-2-2','15-2-3','15-2-6','15-2-7','16-2-1','18-2-1','20-2','21-2-1') THEN b0 END AS pb0,
    CASE WHEN article IN ('3-2-1','4-2-3') THEN a1 END AS pa1, CASE WHEN article IN ('3-2-1','4-2-3') THEN b1 END AS pb1,
    CASE WHEN article IN ('4-1-3','4-2-3') THEN a2
      WHEN article = '15-2-4' THEN CASE WHEN a2 IS NULL AND t1 IS NOT NULL THEN t3 ELSE coalesce(a2, 200) END
      WHEN article = '15-2-5' THEN CASE WHEN a2 IS NULL AND t1 IS NULL AND v1 IS NOT NULL THEN v2 ELSE coalesce(a2, 200) END END AS pa2,
    CASE WHEN article IN ('4-1-3','4-2-3') THEN b2 END AS pb2,
    CASE WHEN article LIKE '1-%' THEN dl WHEN article IN ('10-1-1','10-2-3') THEN coalesce(kd + 100, 200)
      WHEN article LIKE '3-%' OR article LIKE '4-%' OR article LIKE '5-%' THEN 200
      WHEN article LIKE '8-%' THEN 150 WHEN article = '15-2-5' THEN 1000
      WHEN article = '15-2-4' THEN CASE WHEN a2 IS NULL AND t1 IS NOT NULL THEN t2 ELSE coalesce(b0, a0, 0) END
      WHEN article LIKE '15-%' THEN coalesce(l0, 1000)
      WHEN article LIKE '16-%' OR article LIKE '18-%' OR article LIKE '2_-%' THEN coalesce(l0, 200) END AS pl0,
    CASE WHEN article LIKE '10-%' THEN 50 END AS pl1, CASE WHEN article LIKE '4-%' THEN 100 END AS pl2,
    CASE WHEN article LIKE '6-%' THEN CASE WHEN coalesce(d0, greatest(a0, b0), 0) <= 950 THEN 25 ELSE 35 END WHEN article LIKE '12-%' THEN 0 END AS pp0,
    CASE WHEN article LIKE '2-1-%' THEN coalesce(r0, d0) WHEN article LIKE '2-2-%' THEN coalesce(r0, greatest(a0, b0)) END AS pr0,
    CASE WHEN article LIKE '2-%' THEN coalesce(u0, 90) END AS pu0
  FROM articled),
mats(article, codes) AS (VALUES {codes}),
listed(article) AS (VALUES {allowed}),
out AS (
  SELECT valued.*, listed.article IS NOT NULL AS ordered,
    CASE WHEN duct AND ul IN {in_list(fv.METRE_UNITS)} THEN
        CASE WHEN qty <= 0 OR dl <= 0 THEN 0 ELSE greatest(1, CAST(round_even(qty / (dl / 1000.0), 0) AS BIGINT)) END
      WHEN ul IN {in_list(fv.PIECE_UNITS)} THEN CAST(trunc(qty) AS BIGINT)
      ELSE greatest(1, CAST(round_even(qty, 0) AS BIGINT)) END AS pieces,
    CASE WHEN mats.codes IS NOT NULL AND NOT contains(mats.codes, code) THEN mats.codes[1] ELSE code END AS final_code,
    CASE WHEN mats.codes IS NOT NULL AND NOT contains(mats.codes, code) THEN
      concat('материал ', code, ' не поддерживается артикулом ', valued.article, ', использован ', mats.codes[1]) END AS mat_warning,
    CASE WHEN route = 'fitting' AND ptype = 'transition' THEN CASE WHEN valued.article LIKE '3-3%' THEN '6200' WHEN circ THEN '2200' ELSE '6600' END
      WHEN duct THEN CASE WHEN is_rect_size THEN '6600' ELSE '2200' END ELSE '0000' END AS sides,
    CASE WHEN route = 'adapter' THEN concat('КСД адаптер: ', txt)
      WHEN route = 'fitting' AND ptype = 'cap' THEN concat(name, ' ', coalesce(CAST(coalesce(d0, greatest(a0, b0)) AS VARCHAR), '0')) ELSE txt END AS plain_comment,
    CASE WHEN route = 'bad_quantity' THEN concat({q(fv.REASON_QUANTITY_PREFIX)}, quantity)
      WHEN valued.article IS NULL THEN CASE WHEN ptype = 'aggregate_fittings' THEN {q(fv.REASON_AGGREGATE)}
        WHEN ptype = 'diffuser' THEN {q(fv.REASON_DIFFUSER)}
        WHEN ptype IN {in_list(fv.REASON_EQUIPMENT_TYPES)} THEN concat(ptype, {q(fv.REASON_EQUIPMENT_SUFFIX)})
        WHEN sz = '' THEN {q(fv.REASON_NO_SIZE)} WHEN ul IN {in_list(fv.AREA_UNITS)} THEN {q(fv.REASON_AREA_UNIT)}
        ELSE {q(fv.REASON_UNKNOWN)} END
      WHEN listed.article IS NULL THEN concat({q(fv.REASON_NOT_ALLOWED[0])}, valued.article, {q(fv.REASON_NOT_ALLOWED[1])}) END AS reason
  FROM valued LEFT JOIN mats USING (article) LEFT JOIN listed USING (article))"""


PARAMS = "concat_ws(',', " + ", ".join(
    f"'{k}=' || CAST(CAST({c} AS BIGINT) AS VARCHAR)"
    for k, c in [
        ("A0", "pa0"), ("A1", "pa1"), ("A2", "pa2"), ("B0", "pb0"), ("B1", "pb1"), ("B2", "pb2"),
        ("D0", "pd0"), ("D1", "pd1"), ("D2", "pd2"), ("L0", "pl0"), ("L1", "pl1"), ("L2", "pl2"),
        ("P0", "pp0"), ("R0", "pr0"), ("U0", "pu0"),
    ]
) + ")"
COMMENT = (
    "CASE WHEN coalesce(mat_warning, ocr_warning) IS NULL THEN plain_comment ELSE trim(concat_ws(' ', plain_comment, "
    "'[' || mat_warning || ']', '[' || ocr_warning || ']')) END"
)
