"""SQL for the check database: each query again, as one text over the driver's tables.

The texts state the plain semantics (for the walk: every hop from every known person, edges
gathered hop by hop) and share nothing with the Spark operators but the input expressions, so
that they check the shortcuts those operators take.
"""

from __future__ import annotations

from kinspark.plans import census_inputs as inputs
from kinspark.sources.codebook import CODEBOOK_PATTERN
from kinspark.sources.schemas import CENSUS_WIDTHS, EXTRACT_COLUMNS
from kinspark.sources.zones import zone_rows


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in expressions.items())


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_CENSUS = f"""
SELECT {", ".join(f"{inputs.PERSON[name]} AS {name}" for name in CENSUS_WIDTHS)}
FROM (SELECT {_columns(inputs.HOUSEHOLD)} FROM orders JOIN customer ON o_custkey = c_custkey) AS hh,
     (VALUES (1), (2), (3), (4), (5), (6)) AS slots(i)
WHERE {inputs.KEPT_MEMBER}"""

_PERSON = """
SELECT
  left(year || serial || couple, 16) AS famcode,
  CASE WHEN couple IS NULL THEN '0' WHEN unmc THEN '3' ELSE sex END AS rolecode,
  year::SMALLINT AS cenyear,
  (CASE WHEN coalesce(birthyr, '9999') = '9999' THEN year::INT - age::INT ELSE birthyr::INT END)::SMALLINT
    AS birthyr,
  age::SMALLINT AS age, sex, race, bpl, labforce, sploc, poploc, momloc, steppop, stepmom, histid, gq,
  hhtype, relate, famunit, farm, stateicp, countyicp, enumdist,
  CASE WHEN nativity NOT LIKE '% %' THEN nativity END AS nativity,
  CASE WHEN marst NOT LIKE '% %' THEN marst END AS marst,
  CASE WHEN multgen NOT LIKE '% %' THEN multgen END AS multgen,
  CASE WHEN hik NOT LIKE '%     %' THEN hik END AS hik,
  coalesce(hik NOT LIKE '%     %', false) AS hiklink,
  coalesce(relate = '01', false) AS hhead,
  single AS unmarried, haspar AS child, unmc,
  coalesce(age::INT < 18 AND single AND labforce <> '2', false) AS minor,
  stateicp || countyicp AS countycode,
  left(year || serial, 12) AS household,
  left(year || serial || pernum, 16) AS personcode,
  held AS slavenum,
  (CASE WHEN slaveown NOT LIKE '% %' THEN slaveown::INT ELSE 0 END)::SMALLINT AS slaveown,
  CASE WHEN held > 19 THEN '3' WHEN held > 5 THEN '2' WHEN held > 0 THEN '1' ELSE '0' END AS slvhcat
FROM (
  SELECT *,
    CASE WHEN unmc THEN poploc || momloc
         WHEN single AND haspar THEN NULL
         WHEN sex = '1' THEN right(pernum, 2) || sploc
         WHEN sex = '2' THEN sploc || right(pernum, 2) END AS couple,
    (CASE WHEN slavenum NOT LIKE '% %' THEN slavenum::INT ELSE 0 END)::SMALLINT AS held
  FROM (
    SELECT *, coalesce(sploc = '00', false) AS single,
      coalesce(momloc <> '00' OR poploc <> '00', false) AS haspar,
      coalesce(sploc = '00' AND (momloc <> '00' OR poploc <> '00'), false) AS unmc
    FROM census))"""

_FAMCOUNT = """
SELECT a.famcode, a.adults, c.children
FROM (SELECT famcode, count(*) AS adults FROM person WHERE NOT unmc GROUP BY famcode) AS a
LEFT JOIN (SELECT famcode, count(*) AS children FROM person WHERE unmc GROUP BY famcode) AS c
  ON a.famcode = c.famcode"""

_MEMBER = """
SELECT p.* EXCLUDE (famcode, hik, enumdist), v.famcode AS famcode,
  CASE WHEN p.hik NOT LIKE '%    %' THEN p.hik END AS hik,
  CASE WHEN p.enumdist NOT LIKE '%  %' THEN p.enumdist END AS enumdist,
  row_number() OVER (PARTITION BY v.famcode
    ORDER BY p.rolecode NULLS LAST, p.birthyr NULLS LAST, p.personcode NULLS LAST) AS famseq,
  dense_rank() OVER (PARTITION BY p.cenyear, p.countycode ORDER BY p.famcode NULLS LAST) AS famno,
  v.adults::SMALLINT AS famadults, v.children AS famchildren,
  coalesce(NOT p.unmc AND ((v.adults = 2 AND p.rolecode = '1')
    OR (v.adults = 1 AND p.rolecode <> '3')), false) AS famhead,
  coalesce(NOT p.unmc AND v.children > 0, false) AS parent,
  coalesce(NOT p.unmc AND v.adults = 2, false) AS couple,
  coalesce(p.steppop <> '0' AND p.stepmom <> '0', false) AS stepfam,
  true AS cfu,
  (SELECT max(13 + o_orderkey % 3)::INT FROM orders) AS batch
FROM (SELECT * FROM famcount WHERE adults = 2 OR (adults = 1 AND children > 0)) AS v
LEFT JOIN person AS p ON p.famcode = v.famcode"""

_MASTER = " UNION ".join(
    f"(SELECT * FROM extract WHERE hik IS NOT NULL AND {inputs.in_region(j)})" for j in range(inputs.EXTRACT_COUNT)
)

_FIRSTSEX = """
SELECT DISTINCT ON (hik) hik, sex FROM master
ORDER BY hik, sex NULLS LAST, cenyear NULLS LAST, personcode NULLS LAST"""

_PAIRS = """
SELECT DISTINCT a.famcode, a.hik AS phik, a.sex AS bsx, c.hik AS chik, c.sex AS csx
FROM master AS a JOIN master AS c USING (famcode)
WHERE a.rolecode IN ('1', '2') AND c.rolecode = '3'"""

_DESCENT = """
SELECT chik AS src, phik AS tgt, bsx AS edg, csx AS sxs, bsx AS sxt, 1.0::DOUBLE AS weight
FROM pairs
QUALIFY row_number() OVER (PARTITION BY phik, chik ORDER BY bsx NULLS LAST, csx NULLS LAST) = 1"""

_MARRIAGE = """
SELECT DISTINCT h.hik AS src, w.hik AS tgt, '0' AS edg, hs.sex AS sxs, ws.sex AS sxt, 1.0::DOUBLE AS weight
FROM master AS h
JOIN master AS w ON w.famcode = h.famcode AND w.rolecode = '2'
JOIN firstsex AS hs ON hs.hik = h.hik
JOIN firstsex AS ws ON ws.hik = w.hik
WHERE h.rolecode = '1' AND h.hik <> w.hik"""

_ATTRIBUTES_ORDER = ", ".join(
    f"p.{c} NULLS LAST" for c in ("birthyr", "farm", "sex", "race", "bpl")
)


def _base(years: str, extra: str = "") -> str:
    return f"""
SELECT DISTINCT ON (p.hik) p.hik, p.sex, p.race, p.birthyr, p.bpl, p.farm,
  coalesce(s.slvhcat, '0') AS slvhcat
FROM master AS p
LEFT JOIN slaveholder AS s ON s.hik = p.hik
WHERE p.hik IN (
  SELECT m.hik FROM master AS m JOIN county AS z ON z.countycode = m.countycode
  WHERE z.zone = 'KB' AND m.cenyear IN ({years}) {extra})
ORDER BY p.hik, {_ATTRIBUTES_ORDER}, s.slvhcat NULLS LAST"""


_CTES: dict[str, tuple[str, list[str]]] = {
    "census": (_CENSUS, []),
    "person": (_PERSON, ["census"]),
    "famcount": (_FAMCOUNT, ["person"]),
    "member": (_MEMBER, ["famcount"]),
    "extract": (f"SELECT {', '.join(EXTRACT_COLUMNS)} FROM member", ["member"]),
    "master": (_MASTER, ["extract"]),
    "firstsex": (_FIRSTSEX, ["master"]),
    "pairs": (_PAIRS, ["master"]),
    "descent": (_DESCENT, ["pairs"]),
    "marriage": (_MARRIAGE, ["firstsex"]),
    "kin": ("SELECT * FROM descent UNION SELECT * FROM marriage", ["descent", "marriage"]),
    "county": (
        f"SELECT DISTINCT stateicp || countyicp AS countycode, {inputs.ZONE_OF_STATE} AS zone FROM census",
        ["census"],
    ),
    "slaveholder": (
        "SELECT hik, max(slvhcat) AS slvhcat FROM master WHERE slvhcat <> '0' GROUP BY hik",
        ["master"],
    ),
    "adult": (
        "SELECT hik, min(sex) AS sex FROM master WHERE rolecode IN ('1', '2') GROUP BY hik",
        ["master"],
    ),
    "base": (_base("1870"), ["slaveholder", "county"]),
    "edge": ("SELECT src, tgt, edg, weight, sxs, sxt FROM kin WHERE edg <> '0'", ["kin"]),
    "seed": ("SELECT hik FROM base", ["base"]),
}


def _half_round(number: int, known: str, direction: str, hops: int = 3) -> dict[str, tuple[str, list[str]]]:
    """CTEs of one half-round from everyone in ``known``: its hops, its edges, and who is known after."""
    near, far = ("src", "tgt") if direction == "up" else ("tgt", "src")
    ctes, frontier = {}, f"SELECT hik FROM {known}"
    deps = ["edge", known]
    for hop in range(1, hops + 1):
        name = f"hop_{number}_{hop}"
        ctes[name] = (f"SELECT * FROM edge WHERE {near} IN ({frontier})", deps)
        frontier, deps = f"SELECT {far} FROM {name}", ["edge", name]
    hop_names = list(ctes)
    edges = f"edges_{number}"
    ctes[edges] = (" UNION ".join(f"SELECT * FROM {n}" for n in hop_names), hop_names)
    ctes[f"known_{number}"] = (
        f"SELECT src AS hik FROM {edges} UNION SELECT tgt FROM {edges} UNION SELECT hik FROM {known}",
        [edges, known],
    )
    return ctes


def _lineage_ctes() -> dict[str, tuple[str, list[str]]]:
    ctes, known = {}, "seed"
    for number in range(1, 7):
        ctes.update(_half_round(number, known, "up" if number % 2 else "down"))
        known = f"known_{number}"
    all_edges = [f"edges_{n}" for n in range(1, 7)]
    ctes["line"] = (" UNION ".join(f"SELECT * FROM {n}" for n in all_edges), all_edges)
    ctes["wedding"] = (
        """SELECT src, tgt, edg, weight, sxs, sxt FROM kin
        WHERE edg = '0' AND (
          src IN (SELECT src FROM line WHERE sxs = '1' UNION SELECT tgt FROM line WHERE sxt = '1')
          OR tgt IN (SELECT src FROM line WHERE sxs = '2' UNION SELECT tgt FROM line WHERE sxt = '2'))""",
        ["kin", "line"],
    )
    ctes["graph"] = ("SELECT * FROM line UNION SELECT * FROM wedding", ["line", "wedding"])
    ctes["graph_person"] = ("SELECT src AS hik FROM graph UNION SELECT tgt FROM graph", ["graph"])
    return ctes


_CTES.update(_lineage_ctes())
_down = _half_round(9, "seed", "down")
_CTES.update({name: _down[name] for name in _down if name.startswith(("hop", "edges"))})


def _with(select: str, *needs: str) -> str:
    """The query with every CTE it needs, in order, each evaluated once."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][1]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name][0]})" for name in ordered)
    return f"WITH {ctes}\n{select}"


_FIRST_BATCH = "SELECT batch FROM {0} ORDER BY batch DESC NULLS FIRST LIMIT 1"

_STUDY = f"""
SELECT DISTINCT ON (p.hik) p.hik, p.sex, p.race, p.birthyr, p.bpl, p.farm,
  coalesce(s.slvhcat, '0') AS slvhcat,
  CASE WHEN p.hik IN (SELECT hik FROM adult WHERE sex IS NOT NULL) THEN '1' ELSE '0' END AS adult
FROM master AS p
LEFT JOIN slaveholder AS s ON s.hik = p.hik
WHERE p.hik IN (SELECT hik FROM graph_person)
ORDER BY p.hik, {_ATTRIBUTES_ORDER}, s.slvhcat NULLS LAST"""


def _fixed_width() -> str:
    padded = [f"rpad(coalesce({name}, ''), {width}, ' ') AS {name}" for name, width in CENSUS_WIDTHS.items()]
    return f"SELECT {', '.join(padded)} FROM census"


def _codebook() -> str:
    groups = ", ".join(
        f"regexp_extract(value, '{CODEBOOK_PATTERN}', {i}) AS \"{name}\""
        for i, name in enumerate(("variable", "basis", "range", "length"), start=1)
    )
    lines = f"SELECT {inputs.CODEBOOK_LINE} AS value FROM orders"
    return f"SELECT {groups} FROM ({lines}) WHERE regexp_matches(value, '{CODEBOOK_PATTERN}')"


def check_sql() -> dict[str, str]:
    wide = ["famno", "unmc", "famadults", "famchildren", "household", "histid", "gq", "cfu"]
    private = {
        "private": (
            "SELECT * FROM person WHERE hhtype IN ('1', '2', '3') AND gq IN ('1', '2')",
            ["person"],
        ),
        "private_count": (_FAMCOUNT.replace("FROM person", "FROM private"), ["private"]),
        "private_member": (
            _MEMBER.replace("famcount", "private_count").replace("JOIN person", "JOIN private"),
            ["private_count"],
        ),
    }
    _CTES.update(private)
    return {
        "census_famcode": _with("SELECT personcode, famcode, rolecode FROM person", "person"),
        "census_person": _with(
            """SELECT personcode, household, cenyear, birthyr, age, sex, race, bpl, labforce, sploc, poploc,
            momloc, steppop, stepmom, histid, gq, hhtype, relate, famunit, farm, stateicp, countyicp,
            enumdist, nativity, marst, multgen, hik, hiklink, countycode FROM person""",
            "person",
        ),
        "census_flags": _with(
            "SELECT personcode, hhead, unmarried, child, unmc, minor FROM person", "person"
        ),
        "census_slaveholding": _with("SELECT personcode, slavenum, slaveown, slvhcat FROM person", "person"),
        "family_counts": _with(
            """SELECT famcode, adults, children,
            coalesce(adults = 2 OR (adults = 1 AND children > 0), false) AS valid FROM famcount""",
            "famcount",
        ),
        "family_members": _with(
            """SELECT personcode, famcode, rolecode, famhead, parent, couple, stepfam, famadults, famchildren
            FROM member""",
            "member",
        ),
        "family_sequence": _with("SELECT famcode, famseq, personcode, rolecode, birthyr FROM member", "member"),
        "family_number": _with(
            "SELECT DISTINCT cenyear, countycode, famcode, famno FROM member", "member"
        ),
        "census_extract": _with("SELECT * FROM extract", "extract"),
        "family_members_wide": _with(f"SELECT {', '.join(EXTRACT_COLUMNS + wide)} FROM member", "member"),
        "census_extract_private_hh": _with(
            f"SELECT {', '.join(EXTRACT_COLUMNS)} FROM private_member", "private_member"
        ),
        "batch_latest": "SELECT batch FROM (SELECT DISTINCT (13 + o_orderkey % 3)::INT AS batch FROM orders)"
        " ORDER BY batch DESC NULLS FIRST LIMIT 1",
        "zone_dim": _with(
            f"""SELECT countycode, zone, type, origin, region_code, axis, region_name FROM county
            JOIN (VALUES {_values(zone_rows())}) AS z(zone, type, origin, region_code, axis, region_name)
            USING (zone)""",
            "county",
        ),
        "codebook_parse": _codebook(),
        "fixed_width_load": _with(_fixed_width(), "census"),
        "codebook_load": _with(_fixed_width(), "census"),
        "hierarchical_load": _with(_fixed_width(), "census"),
        "distinct_on": _with(
            f"SELECT DISTINCT ON (hik) hik, sex, race, birthyr, bpl, farm FROM master AS p"
            f" ORDER BY hik, {_ATTRIBUTES_ORDER}",
            "master",
        ),
        "unique_persons": _with("SELECT * FROM firstsex", "firstsex"),
        "adult_hiks": _with("SELECT * FROM adult", "adult"),
        "child_hiks": _with(
            """SELECT * FROM (SELECT DISTINCT ON (hik) hik, rolecode, cenyear, sex FROM master
            ORDER BY hik, rolecode NULLS LAST, cenyear DESC NULLS FIRST, sex NULLS LAST)
            WHERE rolecode = '3'""",
            "master",
        ),
        "master_census": _with("SELECT * FROM master", "master"),
        "parent_child_pairs": _with("SELECT * FROM pairs", "pairs"),
        "descent_links": _with("SELECT * FROM descent", "descent"),
        "marriage_links": _with("SELECT * FROM marriage", "marriage"),
        "kinship_links": _with("SELECT * FROM kin", "kin"),
        "base_population": _with("SELECT * FROM base", "base"),
        "base_population_adults": _with(
            _base("1870, 1880", "AND m.rolecode IN ('1', '2')"), "slaveholder", "county"
        ),
        "lineage_hop_up": _with("SELECT * FROM hop_1_1", "hop_1_1"),
        "lineage_hop_down": _with("SELECT * FROM hop_9_1", "hop_9_1"),
        "ancestors_3": _with("SELECT * FROM edges_1", "edges_1"),
        "descendants_3": _with("SELECT * FROM edges_9", "edges_9"),
        "lineage_round_1": _with("SELECT * FROM edges_1 UNION SELECT * FROM edges_2", "edges_2", "edges_1"),
        "lineage_links": _with("SELECT * FROM line", "line"),
        "lineage_members": _with("SELECT * FROM known_6", "known_6"),
        "lineage_marriages": _with("SELECT * FROM wedding", "wedding"),
        "lineage_adult_only": _with(
            "SELECT * FROM line WHERE src IN (SELECT hik FROM adult)", "line", "adult"
        ),
        "linked_families": _with("SELECT * FROM graph", "graph"),
        "study_ids": _with("SELECT * FROM graph_person", "graph_person"),
        "study_population": _with(_STUDY, "graph_person", "slaveholder", "adult"),
    }
