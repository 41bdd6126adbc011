"""The queries in SQL (DuckDB's dialect), as one chain of named steps and an end for each query."""

from __future__ import annotations

import re

from spotlattice.functions.exprs import device_order, parse_index_ranges
from spotlattice.functions.genome import COHORT_LOCI, HG38
from spotlattice.operators.barcodes import X_SELECTED, Y_SELECTED
from spotlattice.operators.reads import LINKER

_CHROM = ", ".join(f"('{c}', {i}, {n}::BIGINT)" for i, (c, n) in enumerate(HG38.items()))
_AUTO = "chr <> 'chrX'"


def _dna(expr: str) -> str:
    return f"translate(md5(({expr})::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _tiles(size: int) -> str:
    return f"""chrom(chr, ord, size) AS (VALUES {_CHROM}),
offs AS (SELECT *, (size + {size - 1}) // {size} AS nb, coalesce(sum((size + {size - 1}) // {size}) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM chrom),
tiles AS (SELECT (off + b)::INT AS bin_id, chr, (b * {size})::BIGINT AS start, least((b + 1) * {size}, size)::BIGINT AS "end" FROM offs, unnest(range(nb)) AS t(b))"""


_BASE = f"""{_tiles(10_000_000)},
bins AS (SELECT *, 0.30::DOUBLE + ((bin_id * 37) % 101)::DOUBLE / 303 AS gc, 0.40::DOUBLE + ((bin_id * 53) % 97)::DOUBLE / 161 AS mappability, CASE WHEN bin_id % 29 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS blacklist FROM tiles),
li AS (SELECT (l_suppkey % 10 + 1)::INT AS x, ((l_orderkey // 7) % 10 + 1)::INT AS y, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 316 AS b, (l_partkey * 1009) % 9000000 AS o, l_linenumber, l_suppkey FROM lineitem),
frags AS (SELECT chr, start + o AS start, start + o + 100 + l_linenumber AS "end", x, y, l_suppkey FROM li JOIN bins ON bin_id = b
          WHERE NOT (chr = 'chr8' AND l_linenumber % 2 = 1 AND (2*x-11)*(2*x-11) + (2*y-11)*(2*y-11) < 40.96::DOUBLE)),
placed AS (SELECT ((x - 1) * 10 + y - 1)::INT AS spot_id, x AS x_id, y AS y_id, (off + least(((start + "end") // 2) // 10000000, nb - 1))::INT AS bin_id
           FROM frags JOIN offs USING (chr) WHERE NOT (x = 10 AND y = 10) AND NOT (x = 9 AND y = 9)),
counts AS (SELECT spot_id, bin_id, count(*) AS n FROM placed GROUP BY ALL),
spots AS (SELECT spot_id, x_id, y_id, count(*) AS total_frags FROM placed GROUP BY ALL),
bm AS (SELECT bins.*, coalesce(s, 0) / (SELECT count(*) FROM spots)::DOUBLE AS bin_mean FROM bins LEFT JOIN (SELECT bin_id, sum(n) AS s FROM counts GROUP BY 1) USING (bin_id)),
qc AS (SELECT *, bin_mean > 0.2::DOUBLE * (SELECT median(bin_mean) FROM bm WHERE bin_mean > 0) AND gc > 0.35::DOUBLE AND mappability > 0.5::DOUBLE AND blacklist < 0.3::DOUBLE AS pass_qc FROM bm)"""

_GROUPS = """, ggc AS (SELECT bin_id, least(((row_number() OVER (ORDER BY gc, bin_id) - 1) * 20) // count(*) OVER (), 19)::INT AS grp FROM bins),
gmap AS (SELECT bin_id, least(((row_number() OVER (ORDER BY mappability, bin_id) - 1) * 20) // count(*) OVER (), 19)::INT AS grp FROM bins)"""


def _corrected(name: str, source: str, groups: str) -> str:
    return f""", {name} AS (SELECT spot_id, bin_id, CASE WHEN e > 0 THEN v / e * m ELSE 0 END AS v FROM (
  SELECT spot_id, bin_id, v, sum(v) OVER (PARTITION BY spot_id, grp) / k AS e, sum(v) OVER (PARTITION BY spot_id) / 316.0::DOUBLE AS m
  FROM ({source}) JOIN (SELECT bin_id, grp, count(*) OVER (PARTITION BY grp)::DOUBLE AS k FROM {groups}) USING (bin_id)))"""


_CORRECTED = _GROUPS + _corrected("c1", "SELECT spot_id, bin_id, n::DOUBLE AS v FROM counts", "ggc") + _corrected("c2", "SELECT * FROM c1", "gmap")


def _knn(name: str, k: int, source: str = "spots") -> str:
    return f""", {name} AS (SELECT * FROM (SELECT a.spot_id AS src, b.spot_id AS dst, ((a.x_id-b.x_id)*(a.x_id-b.x_id)+(a.y_id-b.y_id)*(a.y_id-b.y_id))::BIGINT AS dist2,
  row_number() OVER (PARTITION BY a.spot_id ORDER BY (a.x_id-b.x_id)*(a.x_id-b.x_id)+(a.y_id-b.y_id)*(a.y_id-b.y_id), b.spot_id)::INT AS rank FROM {source} a, {source} b) WHERE rank <= {k})"""


_DENSE = (
    _CORRECTED
    + _knn("nn", 49)
    + """, dens AS (SELECT src AS spot_id, bin_id, sum(v) / (SELECT least(49, count(*)) FROM spots)::DOUBLE AS v FROM nn JOIN c2 ON dst = c2.spot_id GROUP BY ALL)"""
)


def _relative(name: str, ref: str = "TRUE") -> str:
    """The relative layer, its reference over the spots for which ``ref`` holds."""
    return f""", {name} AS (SELECT l.spot_id, l.bin_id, l.chr, l.lv / CASE WHEN r.m > 0 THEN r.m END AS v FROM libn l
  JOIN (SELECT bin_id, median(lv) AS m FROM libn JOIN spots USING (spot_id) WHERE {ref} GROUP BY 1) r USING (bin_id))"""


_LIBN = (
    _DENSE
    + """, tot AS (SELECT spot_id, sum(v) AS t FROM dens GROUP BY 1),
libn AS (SELECT s.spot_id, q.bin_id, q.chr, coalesce(d.v, 0) / t * (SELECT median(t) FROM tot) AS lv FROM spots s CROSS JOIN (SELECT * FROM qc WHERE pass_qc) q
  JOIN tot ON tot.spot_id = s.spot_id LEFT JOIN dens d ON d.spot_id = s.spot_id AND d.bin_id = q.bin_id)"""
)
_REL = _LIBN + _relative("rel")
_SD = "SELECT stddev_pop(pb) AS sd FROM (SELECT bin_id, median(log2(greatest(v, 1e-3))) AS pb FROM {} WHERE v IS NOT NULL GROUP BY 1)"
_LOG = (
    _REL
    + """, lg AS (SELECT spot_id, bin_id, chr, l - median(l) OVER (PARTITION BY spot_id) AS v FROM (SELECT *, coalesce(log2(greatest(v, 1e-3)), 0) AS l FROM (SELECT spot_id, bin_id, chr, v FROM rel)) WHERE TRUE),
lg0 AS (SELECT spot_id, bin_id, chr, CASE WHEN v IS NULL THEN 0 ELSE log2(greatest(v, 1e-3)) END AS l FROM rel),
lc AS (SELECT spot_id, bin_id, chr, l - m AS v FROM lg0 JOIN (SELECT spot_id, median(l) AS m FROM lg0 GROUP BY 1) USING (spot_id)),
cov AS (SELECT spot_id, log10(total_frags + 1.0::DOUBLE) - (SELECT avg(log10(total_frags + 1.0::DOUBLE)) FROM spots) AS c FROM spots),
res AS (SELECT spot_id, bin_id, chr, v - coalesce(b, 0) * c AS v FROM lc JOIN cov USING (spot_id) JOIN (SELECT bin_id, sum(v * c) / nullif(sum(c * c), 0) AS b FROM lc JOIN cov USING (spot_id) GROUP BY 1) USING (bin_id))"""
).replace(
    """, lg AS (SELECT spot_id, bin_id, chr, l - median(l) OVER (PARTITION BY spot_id) AS v FROM (SELECT *, coalesce(log2(greatest(v, 1e-3)), 0) AS l FROM (SELECT spot_id, bin_id, chr, v FROM rel)) WHERE TRUE),
lg0""",
    """, lg0""",
)


def _smooth(name: str, source: str, lo: float, hi: float) -> str:
    return f""", {name} AS (SELECT spot_id, bin_id, chr, least(greatest(CASE WHEN k >= 3 THEN a + v + b - greatest(a, v, b) - least(a, v, b) ELSE v END, {lo}), {hi}) AS v0,
  least(greatest(CASE WHEN k >= 3 THEN list_sort([a, v, b])[2] ELSE v END, {lo}), {hi}) AS v FROM (
  SELECT spot_id, bin_id, chr, v, count(*) OVER (PARTITION BY spot_id, chr) AS k, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM {source} WINDOW w AS (PARTITION BY spot_id, chr ORDER BY bin_id)))"""


_LOG2 = _LOG + _smooth("lr", "res", -2.0, 2.0)
_CN = (
    _CORRECTED
    + _knn("nn", 49)
    + """, cs AS (SELECT s.spot_id, q.bin_id, q.chr, coalesce(d.v, 0) AS v FROM spots s CROSS JOIN (SELECT * FROM qc WHERE pass_qc) q
  LEFT JOIN (SELECT src AS spot_id, bin_id, sum(v) AS v FROM nn JOIN c2 ON dst = c2.spot_id GROUP BY ALL) d ON d.spot_id = s.spot_id AND d.bin_id = q.bin_id),
ct AS (SELECT spot_id, sum(v) AS t FROM cs GROUP BY 1),
cl AS (SELECT spot_id, bin_id, chr, v / t * (SELECT median(t) FROM ct) AS v FROM cs JOIN ct USING (spot_id)),
cr AS (SELECT spot_id, bin_id, chr, v / CASE WHEN m > 0 THEN m END AS v FROM cl JOIN (SELECT bin_id, median(v) AS m FROM cl GROUP BY 1) USING (bin_id)),
cb AS (SELECT spot_id, median(v) FILTER (WHERE chr <> 'chrX') AS base FROM cr GROUP BY 1),
cx AS (SELECT spot_id, bin_id, chr, coalesce(v / CASE WHEN base > 0 THEN base END * 2, 2) AS v FROM cr JOIN cb USING (spot_id))"""
    + _smooth("cn", "cx", 0.0, 6.0)
    + """, burden AS (SELECT spot_id, avg(CASE WHEN abs(v - 2) > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS cnv_burden FROM cn GROUP BY 1),
prof AS (SELECT bin_id, chr, median(v) AS v FROM cn GROUP BY ALL)"""
)
_LABELS = """, lab AS (SELECT *, CASE WHEN (2*x_id-11)*(2*x_id-11) + (2*y_id-11)*(2*y_id-11) < 40.96::DOUBLE THEN 1 WHEN x_id <= 5 THEN 0 ELSE 2 END AS cluster FROM spots)"""
_EDGES = """, edges AS (SELECT a.spot_id AS i, b.spot_id AS j FROM spots a JOIN spots b ON a.spot_id < b.spot_id AND abs(a.x_id - b.x_id) <= 1 AND abs(a.y_id - b.y_id) <= 1)"""


def _moran(value: str, source: str) -> str:
    return f"(SELECT CASE WHEN n >= 20 AND m >= 10 AND q > 0 THEN n::DOUBLE / m * (s / q) END FROM (SELECT count(*) AS n, sum(z * z) AS q FROM (SELECT {value} - avg({value}) OVER () AS z FROM {source})), (SELECT count(*) AS m, sum(a.z * b.z) AS s FROM edges JOIN (SELECT spot_id, {value} - avg({value}) OVER () AS z FROM {source}) a ON a.spot_id = i JOIN (SELECT spot_id, {value} - avg({value}) OVER () AS z FROM {source}) b ON b.spot_id = j))"


_CLONES = (
    _LOG2
    + _LABELS
    + """, lv AS (SELECT cluster, spot_id, bin_id, v FROM lr JOIN lab USING (spot_id)),
allv AS (SELECT cluster, abs(coalesce(v, 0)) AS a FROM (SELECT l.cluster, lr.v FROM lab l CROSS JOIN bins LEFT JOIN lr ON lr.spot_id = l.spot_id AND lr.bin_id = bins.bin_id)),
flat AS (SELECT cluster, median(a) AS f FROM allv GROUP BY 1),
normal AS (SELECT cluster AS nc FROM flat ORDER BY f, cluster LIMIT 1),
cm AS (SELECT cluster, bin_id, avg(v) AS m FROM lv GROUP BY ALL),
cd AS (SELECT cm.cluster, cm.bin_id, cm.m - n.m AS d FROM cm JOIN (SELECT bin_id, m FROM cm JOIN normal ON cluster = nc) n USING (bin_id)),
cna AS (SELECT cluster, bin_id, d - md AS cna FROM cd JOIN (SELECT cluster, median(d) AS md FROM cd GROUP BY 1) USING (cluster)),
names AS (SELECT cluster, CASE WHEN r = 0 THEN 'Normal' ELSE 'Clone' || r END AS clone, aberration FROM (
  SELECT cluster, aberration, row_number() OVER (ORDER BY cluster = nc DESC, aberration DESC, cluster) - 1 AS r FROM (SELECT cluster, avg(abs(cna)) AS aberration FROM cna GROUP BY 1), normal))"""
)
_SIG = (
    _LABELS
    + _knn("n10", 10)
    + """, reg AS (SELECT 'chr8' AS region, bin_id FROM bins WHERE chr = 'chr8' UNION ALL SELECT 'chr17', bin_id FROM bins WHERE chr = 'chr17' UNION ALL SELECT 'chr8:40-100', bin_id FROM bins WHERE chr = 'chr8' AND start >= 40000000 AND start < 100000000),
rc AS (SELECT region, spot_id, sum(n) AS c FROM counts JOIN reg USING (bin_id) GROUP BY ALL),
rt AS (SELECT region, sum(c) AS total FROM rc GROUP BY 1),
rs AS (SELECT rt.region, src AS spot_id, sum(coalesce(c, 0)) AS obs, sum(p) AS p, max(total) AS total FROM rt CROSS JOIN n10 JOIN (SELECT spot_id, total_frags / sum(total_frags) OVER ()::DOUBLE AS p FROM spots) sp ON sp.spot_id = dst LEFT JOIN rc ON rc.region = rt.region AND rc.spot_id = dst GROUP BY rt.region, src),
rz AS (SELECT region, spot_id, (obs - total * p) / (sqrt(greatest(total * p * (1 - p), 0)) + 1e-9) AS z FROM rs)"""
)
_SEG = _CN + """, seg AS (SELECT bin_id // 3 AS segment, count(*) AS n_bins, avg(v) + CASE WHEN (bin_id // 3) % 7 = 0 THEN 0.5::DOUBLE ELSE 0 END AS mean FROM prof GROUP BY 1),
sd AS (SELECT segment, n_bins, round_even(mean, 4) - 2.0::DOUBLE AS dev FROM seg)"""
_INT = """, pg AS (SELECT CASE WHEN i = 180 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE + i * (0.9::DOUBLE / 180) END AS p FROM range(181) t(i)),
cost AS (SELECT p, sum(n_bins * pow(2 + dev / p - round_even(2 + dev / p, 0), 2)) AS c FROM sd, pg GROUP BY 1),
fit AS (SELECT (SELECT max(abs(dev)) > 0.1 FROM sd) AS ev, (SELECT max(p) FROM cost WHERE c <= (SELECT min(c) FROM cost) * 1.5 + 1e-6) AS p0),
icn AS (SELECT segment, n_bins, dev, ev, CASE WHEN ev THEN p0 ELSE 1 END AS p, 2 + dev / CASE WHEN ev THEN p0 ELSE 1 END AS c FROM sd, fit)"""
_VD = (
    _LABELS
    + """, cells AS (SELECT spot_id, x_id, y_id, CASE WHEN (x_id * 3 + y_id) % 4 = 0 THEN 'Tumor' WHEN (x_id + y_id * 2) % 5 = 0 THEN 'Immune' ELSE 'Stroma' END AS cell_type FROM spots)"""
    + _knn("nv", 10, "cells")
    + """, nd AS (SELECT src AS spot_id, avg((cell_type = 'Tumor')::INT::DOUBLE) AS t, avg((cell_type = 'Immune')::INT::DOUBLE) AS m FROM nv JOIN cells ON cells.spot_id = dst GROUP BY 1),
dn AS (SELECT spot_id, t - avg(t) OVER () AS td, m - avg(m) OVER () AS imd FROM nd),
ex AS (SELECT 'g' || g AS gene, s.spot_id, coalesce(v, 0)::DOUBLE AS y, cluster, td, imd FROM range(20) t(g) CROSS JOIN lab s JOIN dn USING (spot_id)
  LEFT JOIN (SELECT l_partkey % 20 AS pg, (l_suppkey % 10) * 10 + (l_orderkey // 7) % 10 AS sp, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) q ON q.pg = g AND q.sp = s.spot_id),
ce AS (SELECT gene, y - avg(y) OVER g AS yg, td - avg(td) OVER g AS tg, imd - avg(imd) OVER g AS ig, y - avg(y) OVER c AS yc, td - avg(td) OVER c AS tc, imd - avg(imd) OVER c AS ic FROM ex WINDOW g AS (PARTITION BY gene), c AS (PARTITION BY gene, cluster)),
sm AS (SELECT gene, sum(yg*yg) AS tss, sum(yc*yc) AS rc, sum(tg*tg) AS aa, sum(ig*ig) AS bb, sum(tg*ig) AS ab, sum(tg*yg) AS ay, sum(ig*yg) AS by_, sum(tc*tc) AS caa, sum(ic*ic) AS cbb, sum(tc*ic) AS cab, sum(tc*yc) AS cay, sum(ic*yc) AS cby FROM ce GROUP BY 1),
vx AS (SELECT gene, tss, (ay*ay*bb - 2*ay*by_*ab + by_*by_*aa) / (aa*bb - ab*ab) AS sd, (cay*cay*cbb - 2*cay*cby*cab + cby*cby*caa) / (caa*cbb - cab*cab) AS sc, rc FROM sm),
vd AS (SELECT gene, greatest(tss - sd - (rc - sc), 0) / tss AS g, greatest(sc, 0) / tss AS m, (rc - sc) / tss AS r FROM vx)"""
)
_COHORT = f"""{_BASE},
cf AS (SELECT r_name AS sample, chr, (start + "end") // 2 AS mid, (start % 25)::INT AS spot_id FROM frags JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
cc AS (SELECT sample, spot_id, (off + mid // 10000000)::INT AS bin_id, count(*)::DOUBLE AS v FROM cf JOIN offs USING (chr) GROUP BY ALL),
csp AS (SELECT DISTINCT sample, spot_id FROM cc),
cpb AS (SELECT p.sample, b.bin_id, b.chr, b.start, b."end", median(coalesce(v, 0) + 0.5::DOUBLE) AS pb FROM csp p CROSS JOIN bins b LEFT JOIN cc ON cc.sample = p.sample AND cc.spot_id = p.spot_id AND cc.bin_id = b.bin_id GROUP BY ALL),
cbase AS (SELECT sample, CASE WHEN median(pb) FILTER (WHERE {_AUTO}) > 0 THEN median(pb) FILTER (WHERE {_AUTO}) ELSE median(pb) END AS base FROM cpb GROUP BY 1),
cp AS (SELECT sample, bin_id, chr, start, "end", log2(greatest(pb / nullif(base, 0), 1e-3)) AS l FROM cpb JOIN cbase USING (sample))"""
_LOCI = ", ".join(f"('{k}', '{c}', {int(mb * 1e6)})" for k, (c, mb) in COHORT_LOCI.items())


def _axis(spec: str) -> str:
    true = device_order()
    return ", ".join(f"({r}, {i}, {true[i]})" for i, r in enumerate(parse_index_ranges(spec), 1))


def _ham(a: str, b: str) -> str:
    return f"hamming({a}, {b})"


_REFS = f"""xr AS (SELECT code, min(k)::INT AS ref_index FROM (SELECT k, substr({_dna('k')}, 1, 8) AS code FROM range(1, 193) t(k)) GROUP BY 1),
yr AS (SELECT code, min(k)::INT AS ref_index FROM (SELECT k, substr({_dna('k + 1000')}, 1, 8) AS code FROM range(1, 193) t(k)) GROUP BY 1),
ol AS (SELECT l_orderkey, l_linenumber % 6 AS k, substr({_dna('l_suppkey % 192 + 1')}, 1, 8) AS x, substr({_dna('l_partkey % 192 + 1001')}, 1, 8) AS y, (l_orderkey % 8)::INT AS p FROM lineitem),
obs AS (SELECT barcode, count(*) AS fragments FROM (SELECT CASE k WHEN 1 THEN substr(x, 1, p) || 'T' || substr(x, p + 2) || y WHEN 2 THEN x || substr(y, 1, p) || 'N' || substr(y, p + 2)
  WHEN 3 THEN substr(x || y, 1, 15) WHEN 4 THEN substr({_dna('l_orderkey')}, 1, 16) ELSE lower(x || y) END AS barcode FROM ol) GROUP BY 1)"""


def _match(name: str, refs: str, source: str, most: int = 1) -> str:
    """name(half, status, match, mm) for the distinct halves of source(half)."""
    return f""", {name} AS (SELECT half, CASE WHEN length(half) <> 8 THEN 'bad_length' WHEN d IS NULL THEN 'unmapped' WHEN d = 0 THEN 'exact' WHEN c > 1 THEN 'ambiguous' ELSE 'corrected' END AS status,
  CASE WHEN d = 0 OR (d > 0 AND c = 1) THEN code END AS match, d::INT AS mm FROM (SELECT h.half, min(d) AS d, count(*) AS c, min(code) AS code FROM (SELECT DISTINCT half FROM ({source})) h
  LEFT JOIN (SELECT half, code, d, min(d) OVER (PARTITION BY half) AS least FROM (SELECT half, code, {_ham('half', 'code')} AS d FROM (SELECT DISTINCT half FROM ({source}) WHERE length(half) = 8), {refs}) WHERE d <= {most}) m ON m.half = h.half AND d = least GROUP BY h.half))"""


_MATCH = (
    _REFS
    + ", ob AS (SELECT upper(trim(barcode)) AS bc, fragments FROM obs)"
    + _match("xm", "xr", "SELECT substr(bc, 1, 8) AS half FROM ob WHERE length(bc) = 16")
    + _match("ym", "yr", "SELECT substr(bc, 9, 8) AS half FROM ob WHERE length(bc) = 16")
    + f""", xa(ref_index, load_order, true_order) AS (VALUES {_axis(X_SELECTED)}), ya(ref_index, load_order, true_order) AS (VALUES {_axis(Y_SELECTED)}),
mt AS (SELECT *, CASE WHEN length(bc) <> 16 THEN 'bad_length' WHEN x_status IN ('exact', 'corrected') AND y_status IN ('exact', 'corrected') THEN 'mapped' WHEN x_status = 'ambiguous' OR y_status = 'ambiguous' THEN 'ambiguous' ELSE 'unmapped' END AS full_status
  FROM (SELECT bc, fragments, xm.status AS x_status, ym.status AS y_status, xm.match AS xb, ym.match AS yb FROM ob LEFT JOIN xm ON length(bc) = 16 AND xm.half = substr(bc, 1, 8) LEFT JOIN ym ON length(bc) = 16 AND ym.half = substr(bc, 9, 8))),
mp AS (SELECT mt.*, xr.ref_index AS xi, yr.ref_index AS yi, xa.load_order AS xo, ya.load_order AS yo, xa.true_order AS x_id, ya.true_order AS y_id FROM mt
  LEFT JOIN xr ON full_status = 'mapped' AND xr.code = xb LEFT JOIN yr ON full_status = 'mapped' AND yr.code = yb LEFT JOIN xa ON xa.ref_index = xr.ref_index LEFT JOIN ya ON ya.ref_index = yr.ref_index),
crop AS (SELECT xb, yb, x_id, y_id, sum(fragments) AS fragments FROM mp WHERE full_status = 'mapped' AND x_id IS NOT NULL AND y_id IS NOT NULL GROUP BY ALL)"""
)
_TAIL = " || ".join(_dna(f"o_orderkey + {i}") for i in (3, 4, 5, 6))
_PAIRS = f"""pr AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 13 = 0 THEN 'ACGTACGTAC' ELSE substr('AC', 1, (o_orderkey % 3)::INT) || substr({_dna('o_custkey % 40')}, 1, 8)
  || CASE o_orderkey % 7 WHEN 0 THEN 'G' || substr('{LINKER}', 2) WHEN 1 THEN 'GG' || substr('{LINKER}', 3) ELSE '{LINKER}' END
  || substr({_dna('o_custkey % 40 + 1')}, 1, 8) || substr({_TAIL}, 1, CASE o_orderkey % 11 WHEN 0 THEN 90 WHEN 1 THEN 4 ELSE 120 END) END AS s1, {_dna('o_orderkey + 9')} AS s2 FROM orders)"""
_FIXED = """, exd AS (SELECT ord, s1, s2, CASE WHEN length(s1) < 34 THEN 'r1_too_short_for_barcode' WHEN length(s1) - 113 < 20 THEN 'short_genomic_R1' END AS drop_reason, substr(s1, 1, 8) || substr(s1, 27, 8) AS barcode, length(s1) - 113 AS g FROM pr)"""
_ANCHOR = f""", lk AS (SELECT ord, min(i) FILTER (WHERE substr(s1, i + 1, 18) = '{LINKER}') AS e, min(i) FILTER (WHERE length(substr(s1, i + 1, 18)) = 18 AND hamming(rpad(substr(s1, i + 1, 18), 18, '-'), '{LINKER}') <= 1) AS n FROM pr, range(5, 12) t(i) GROUP BY 1),
lp AS (SELECT pr.*, coalesce(e, n, -1)::INT AS pos FROM pr JOIN lk USING (ord)),
exa AS (SELECT *, CASE WHEN pos < 0 THEN 'no_linker' WHEN pos < 8 OR length(substr(s1, pos + 19, 8)) <> 8 THEN 'bad_barcode' WHEN length(s1) - (105 + pos) < 20 THEN 'short_genomic_R1' END AS drop_reason,
  CASE WHEN pos >= 8 THEN substr(s1, pos - 7, 8) ELSE '' END || substr(s1, pos + 19, 8) AS barcode, length(s1) - (105 + pos) AS g FROM lp)"""
_SAM = f"""sam AS (SELECT CASE WHEN l_partkey % 17 = 0 THEN 'r' || l_orderkey ELSE 'r' || l_orderkey || '_CB=' || substr({_dna('l_suppkey % 50')}, 1, 8) || ':1' END AS qname,
  CASE l_linenumber % 4 WHEN 0 THEN 99 WHEN 1 THEN 83 WHEN 2 THEN 147 ELSE 1123 END AS flag, 'chr' || (l_suppkey % 22 + 1) AS chr, (l_orderkey * 7919 + l_partkey * 31) % 50000000 + 1 AS pos, (l_partkey % 60)::INT AS mapq,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (l_orderkey % 1300) AS tlen FROM lineitem),
q30 AS (SELECT * FROM sam WHERE flag & 2 = 2 AND flag & 1804 = 0 AND mapq >= 30),
al AS (SELECT chr, pos - 1 AS start, pos + 49 AS "end", CASE WHEN flag IN (99, 147) THEN '+' ELSE '-' END AS strand FROM sam),
cut AS (SELECT chr, CASE WHEN strand = '+' THEN start ELSE "end" - 1 END AS start, strand FROM al),
tss AS (SELECT DISTINCT chr, greatest(CASE WHEN strand = '+' THEN start - 1 ELSE "end" - 1 END, 0) AS start, CASE WHEN strand = '+' THEN start ELSE "end" END AS "end" FROM (
  SELECT 'chr' || (p_partkey % 22 + 1) AS chr, CASE WHEN p_size % 5 = 0 THEN 'exon' ELSE 'transcript' END AS feature, (p_partkey * 7717) % 50000000 + 1 AS start, (p_partkey * 7717) % 50000000 + 900 AS "end",
  CASE WHEN p_size % 2 = 0 THEN '+' WHEN p_size % 3 = 0 THEN '-' ELSE '.' END AS strand FROM part) WHERE feature = 'transcript' AND strand IN ('+', '-')),
tp AS (SELECT i * 10 - 2000 AS "offset", coalesce(c, 0) AS count FROM range(400) t(i) LEFT JOIN (SELECT (cut.start - tss.start + 2000) // 10 AS k, count(*) AS c FROM tss JOIN cut ON cut.chr = tss.chr AND cut.start >= tss.start - 2000 AND cut.start < tss.start + 2000 GROUP BY 1) ON k = i)"""
_VEC = """vec AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"""
_POINTS = (
    """pt AS (SELECT vec_id::INT AS spot_id, (vec_id // 50 + 1)::INT AS x_id, (vec_id % 50 + 1)::INT AS y_id, embedding AS v FROM embeddings),
pn AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM (
  SELECT a.spot_id AS src, b.spot_id AS dst, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM pt a, pt b)) WHERE r <= 6),
p1 AS (SELECT src AS spot_id, i, avg(v[i + 1]::DOUBLE) AS x FROM pn JOIN pt ON pt.spot_id = dst, range(64) t(i) WHERE i < len(v) GROUP BY ALL)"""
    + _knn("px", 5, "pt")
)

R = "round({}, {}) + 0.0"


def _r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0::DOUBLE AS {name}"


def _with(chain: str, end: str) -> str:
    """Every named step is computed once: inlined, a chain of steps that each read theirs twice has no end."""
    return re.sub(r"(?<=[\w)]) AS \(SELECT", " AS MATERIALIZED (SELECT", f"WITH {chain} {end}")


_RV = _r("v", "value", 6)
_RV5 = _r("v", "value", 5)

ORACLE_SQL: dict[str, str] = {
    "genome_bins": _with(_tiles(1_000_000), 'SELECT bin_id, chr, start, "end" FROM tiles'),
    "counts_per_spot_bin": _with(_BASE, "SELECT * FROM counts"),
    "fragments_in_grid": _with(_BASE, "SELECT x_id, count(*) AS n_fragments, count(DISTINCT spot_id) AS n_spots, count(DISTINCT bin_id) AS n_bins FROM placed GROUP BY 1"),
    "spot_totals": _with(_BASE, "SELECT spot_id, total_frags FROM spots"),
    "empty_spot_filter": _with(_BASE, "SELECT spot_id, sum(n)::BIGINT AS total_frags FROM counts WHERE n > 3 GROUP BY 1"),
    "bin_qc_flags": _with(_BASE, f"SELECT bin_id, {_r('bin_mean', 'bin_mean')}, pass_qc FROM qc"),
    "quantile_groups": _with(_BASE + _GROUPS, "SELECT * FROM ggc"),
    "gc_corrected": _with(_BASE + _CORRECTED, f"SELECT spot_id, bin_id, {_RV} FROM c1"),
    "gc_map_corrected": _with(_BASE + _CORRECTED, f"SELECT spot_id, bin_id, {_RV} FROM c2"),
    "interval_coverage_fraction": _with(
        _BASE + """, iv AS (SELECT 'chr' || (o_custkey % 22 + 1) AS chr, (o_orderkey * 104729) % 40000000 AS s, (o_orderkey * 104729) % 40000000 + (o_custkey * 7919) % 25000000 AS e FROM orders)""",
        """SELECT bin_id, round(coalesce(sum(least(e, (b + 1) * 10000000) - greatest(s, b * 10000000)) FILTER (WHERE s IS NOT NULL), 0) / 10000000.0::DOUBLE, 6) AS fraction FROM (SELECT bin_id, chr, start // 10000000 AS b FROM bins) bins
        LEFT JOIN iv ON iv.chr = bins.chr AND s < (b + 1) * 10000000 AND e > b * 10000000 AND e > s GROUP BY 1""",
    ),
    "gc_lookup_left_join": _with(_BASE, f"SELECT bin_id, {_r('CASE WHEN bin_id % 3 <> 0 THEN gc ELSE 0 END', 'gc')} FROM bins"),
    "knn_xy": _with(_BASE + _knn("n10", 10), "SELECT * FROM n10"),
    "spatial_densify": _with(_BASE + _DENSE, f"SELECT spot_id, bin_id, {_RV} FROM dens"),
    "normalized_relative": _with(_BASE + _REL, f"SELECT spot_id, bin_id, {_RV5} FROM rel"),
    "pseudobulk_log2_sd": _with(_BASE + _REL, f"SELECT {_r('sd', 'sd', 5)} FROM ({_SD.format('rel')})"),
    "normal_anchor_guard": _with(
        _BASE + _REL + _relative("rel2", "x_id <= 4"),
        f"""SELECT (SELECT count(*) FROM spots WHERE x_id <= 4) AS n_reference_spots, {_r('b', 'bulk_sd_before', 5)}, {_r('a', 'bulk_sd_after', 5)}, b > 0 AND a < 0.4 * b AS signal_collapsed
        FROM (SELECT sd AS b FROM ({_SD.format('rel')})), (SELECT sd AS a FROM ({_SD.format('rel2')}))""",
    ),
    "pick_normal_spots": _with(
        _BASE + _CN,
        """, el AS (SELECT spot_id, cnv_burden FROM spots JOIN burden USING (spot_id) WHERE CASE WHEN (SELECT count(*) FROM spots WHERE total_frags >= 100) < 20 THEN total_frags >= (SELECT quantile_cont(total_frags, 0.8) FROM spots) ELSE total_frags >= 100 END)
        SELECT spot_id FROM el WHERE cnv_burden <= (SELECT quantile_cont(cnv_burden, 0.3) FROM el)""",
    ),
    "log2_centered": _with(_BASE + _LOG, f"SELECT spot_id, bin_id, {_RV5} FROM lc"),
    "depth_residualized": _with(_BASE + _LOG, f"SELECT spot_id, bin_id, {_RV5} FROM res"),
    "genome_median_smooth": _with(_BASE + _LOG2, f"SELECT spot_id, bin_id, {_RV5} FROM lr"),
    "copy_number": _with(_BASE + _CN, f"SELECT spot_id, bin_id, {_RV5} FROM cn"),
    "copy_number_burden": _with(_BASE + _CN, f"SELECT spot_id, {_r('cnv_burden', 'cnv_burden')} FROM burden"),
    "adjacency_edges": _with(_BASE + _EDGES, "SELECT i, j FROM edges"),
    "morans_i": _with(_BASE + _EDGES, f"SELECT {_r(_moran('total_frags', 'spots'), 'i')}"),
    "morans_i_permutation_p": _with(
        _BASE + _EDGES,
        f""", zs AS (SELECT spot_id, total_frags - avg(total_frags) OVER () AS z, row_number() OVER (ORDER BY spot_id) AS r FROM spots),
        sh AS (SELECT perm, z, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || spot_id), spot_id) AS r FROM zs, range(1, 1000) AS t(perm)),
        pz AS (SELECT perm, spot_id, sh.z FROM sh JOIN zs USING (r) UNION ALL SELECT 0, spot_id, z FROM zs),
        pi AS (SELECT a.perm, (SELECT count(*) FROM spots)::DOUBLE / count(*) * (sum(a.z * b.z) / (SELECT sum(z * z) FROM zs)) AS i FROM edges JOIN pz a ON a.spot_id = edges.i JOIN pz b ON b.spot_id = edges.j AND b.perm = a.perm GROUP BY 1)
        SELECT {_r('max(i) FILTER (WHERE perm = 0)', 'i')}, {_r('(count(*) FILTER (WHERE perm > 0 AND i >= (SELECT i FROM pi WHERE perm = 0)) + 1) / 1000.0::DOUBLE', 'p')} FROM pi""",
    ),
    "heterogeneity_verdict": _with(
        _BASE + _CN + _EDGES,
        f"SELECT {_r('a', 'moran_coverage')}, {_r('b', 'moran_cnv_burden')}, coalesce(b > a, FALSE) AS cna_exceeds_coverage FROM (SELECT {_moran('total_frags', 'spots')} AS a, {_moran('cnv_burden', 'burden')} AS b)",
    ),
    "channel_stripes": _with(
        _BASE,
        f""", dv AS (SELECT total_frags::DOUBLE AS v, total_frags - avg(total_frags) OVER (PARTITION BY x_id) AS r, total_frags - avg(total_frags) OVER (PARTITION BY y_id) AS c FROM spots),
        vv AS (SELECT var_pop(v) AS t, var_pop(r) AS vr, var_pop(c) AS vc FROM dv), dd AS (SELECT t, (t - vr) / greatest(t, 1e-12) AS row_d, (t - vc) / greatest(t, 1e-12) AS col_d FROM vv)
        SELECT {_r('row_d', 'row_dominance')}, {_r('col_d', 'col_dominance')}, t > 0 AND greatest(row_d, col_d) > 0.5 AND (row_d / greatest(col_d, 1e-6) > 3 OR col_d / greatest(row_d, 1e-6) > 3) AS stripe_artifact FROM dd""",
    ),
    "region_significance_closed_form": _with(
        _BASE + _SIG, f"SELECT region, spot_id, {_r('z - coalesce(m, 0)', 'z', 5)} FROM rz JOIN (SELECT region, avg(z) AS m FROM rz JOIN lab USING (spot_id) WHERE cluster = 0 GROUP BY 1) USING (region)"
    ),
    "clone_names": _with(_BASE + _CLONES, f"SELECT cluster, clone, {_r('aberration', 'aberration', 5)} FROM names"),
    "clone_profiles": _with(_BASE + _CLONES, f"SELECT clone, bin_id, {_r('cna', 'cna', 5)} FROM cna JOIN names USING (cluster)"),
    "clone_diagnostics": _with(
        _BASE + _CLONES,
        f"SELECT {_r('d', 'clone_cna_distinctness')}, 3 AS chosen_k, TRUE AS ch_boundary_k, TRUE AS clones_likely_artifact FROM (SELECT count(*) FILTER (WHERE s > 0.02) / 316.0::DOUBLE AS d FROM (SELECT bin_id, max(cna) - min(cna) AS s FROM cna GROUP BY 1))",
    ),
    "best_split_per_chrom": _with(
        _BASE + _CN,
        f""", sp AS (SELECT chr, row_number() OVER w AS k, sum(v) OVER (PARTITION BY chr ORDER BY bin_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, count(*) OVER (PARTITION BY chr) AS n, sum(v) OVER (PARTITION BY chr) AS t FROM prof WINDOW w AS (PARTITION BY chr ORDER BY bin_id)),
        gn AS (SELECT chr, k, l*l/k + (t-l)*(t-l)/(n-k) - t*t/n AS gain FROM sp WHERE k >= 3 AND k <= n - 3)
        SELECT chr, k::INT AS k, {_r('gain', 'gain')} FROM (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY -round(gain, 9), k) AS r FROM gn) WHERE r = 1""",
    ),
    "segments_called": _with(
        _BASE + _CN,
        f""", ix AS (SELECT chr, bin_id, v, row_number() OVER (PARTITION BY chr ORDER BY bin_id) AS i, v - lag(v) OVER (PARTITION BY chr ORDER BY bin_id) AS d FROM prof),
        cum AS (SELECT chr, i, sum(v) OVER (PARTITION BY chr ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM ix UNION ALL SELECT DISTINCT chr, 0, 0::DOUBLE FROM ix),
        dm AS (SELECT chr, median(d) AS m FROM ix GROUP BY 1),
        pen AS (SELECT chr, count(*) AS n, 2 * pow(greatest(coalesce(1.4826::DOUBLE * median(abs(d - m)) / sqrt(2), 0), 1e-6), 2) * ln(greatest(count(*), 2)) AS p FROM ix JOIN dm USING (chr) GROUP BY 1),
        parts(chr, lo, hi) AS ( SELECT chr, 0::BIGINT, n FROM pen WHERE n >= 3 UNION ALL
          SELECT chr, CASE WHEN side = 0 THEN lo ELSE cut END, CASE WHEN side = 0 THEN cut ELSE hi END FROM (
            SELECT q.chr, lo, hi, arg_max(c.i, pow(c.s - a.s, 2) / (c.i - lo) + pow(b.s - c.s, 2) / (hi - c.i)) AS cut FROM parts q JOIN pen USING (chr) JOIN cum a ON a.chr = q.chr AND a.i = lo JOIN cum b ON b.chr = q.chr AND b.i = hi
            JOIN cum c ON c.chr = q.chr AND c.i BETWEEN lo + 3 AND hi - 3 GROUP BY q.chr, lo, hi, a.s, b.s, p HAVING max(pow(c.s - a.s, 2) / (c.i - lo) + pow(b.s - c.s, 2) / (hi - c.i)) - pow(b.s - a.s, 2) / (hi - lo) > p), (VALUES (0), (1)) AS t(side)),
        leaf AS (SELECT chr, lo, min(hi) AS hi FROM parts GROUP BY ALL)
        SELECT l.chr, f.bin_id AS first_bin, g.bin_id AS last_bin, x.start, y."end", (hi - lo)::INT AS n_bins, {_r('(b.s - a.s) / (hi - lo)', 'mean')}, (row_number() OVER (ORDER BY ord, lo) - 1)::INT AS segment
        FROM leaf l JOIN ix f ON f.chr = l.chr AND f.i = lo + 1 JOIN ix g ON g.chr = l.chr AND g.i = hi JOIN bins x ON x.bin_id = f.bin_id JOIN bins y ON y.bin_id = g.bin_id JOIN cum a ON a.chr = l.chr AND a.i = lo JOIN cum b ON b.chr = l.chr AND b.i = hi JOIN chrom ON chrom.chr = l.chr""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "integer_cn_grid": _with(
        _BASE + _SEG + _INT,
        f"""SELECT {_r('CASE WHEN bool_or(ev) THEN round_even(max(p), 3) END', 'purity', 4)}, {_r('round_even(sum(n_bins * i) / sum(n_bins)::DOUBLE, 2)', 'ploidy', 4)},
        {_r('round_even(coalesce(max(o), 0), 4)', 'max_integer_deviation', 4)}, count(DISTINCT i) AS n_states, bool_or(ev) AND coalesce(max(o), 0) < 0.15 AS resolvable
        FROM (SELECT *, least(greatest(round_even(c, 0), 0), 8)::INT AS i, CASE WHEN abs(dev) > 0.1 THEN abs(c - round_even(c, 0)) END AS o FROM icn)""",
    ),
    "integer_cn_segments": _with(_BASE + _SEG, "SELECT segment::INT AS segment, least(greatest(round_even(2 + dev / 0.8::DOUBLE, 0), 0), 8)::INT AS integer_cn FROM sd"),
    "variance_decomposition": _with(_BASE + _VD, f"SELECT gene, {_r('g', 'vd_genetic')}, {_r('m', 'vd_microenv')}, {_r('r', 'vd_residual')}, CASE WHEN g >= m THEN 'genetic' ELSE 'microenv' END AS vd_dominant FROM vd"),
    "plot_top_variance_genes": _with(_BASE + _VD, f"SELECT gene, {_r('g + m', 'explained')} FROM vd ORDER BY g + m DESC, gene LIMIT 5"),
    "plot_grid_clones": _with(_BASE + _LABELS, "SELECT x_id, y_id, 'c' || cluster AS clone FROM lab"),
    "plot_chromosome_cn": _with(_BASE + _CN, f"SELECT x_id, y_id, {_r('avg(v)', 'value', 5)} FROM cn JOIN spots USING (spot_id) WHERE chr = 'chr8' GROUP BY x_id, y_id"),
    "cohort_profiles": _with(_COHORT, f"SELECT sample, bin_id, {_r('l', 'log2')} FROM cp"),
    "cohort_correlation": _with(_COHORT, f"SELECT a.sample AS sample_a, b.sample AS sample_b, {_r('covar_pop(a.l, b.l) / nullif(stddev_pop(a.l) * stddev_pop(b.l), 0)', 'r')} FROM cp a JOIN cp b USING (bin_id) WHERE a.{_AUTO} GROUP BY ALL"),
    "cohort_correlation_with_chrx": _with(_COHORT, f"SELECT a.sample AS sample_a, b.sample AS sample_b, {_r('covar_pop(a.l, b.l) / nullif(stddev_pop(a.l) * stddev_pop(b.l), 0)', 'r')} FROM cp a JOIN cp b USING (bin_id) GROUP BY ALL"),
    "cohort_sex": _with(_COHORT, f"SELECT sample, {_r('x', 'chrx_mean_log2')}, CASE WHEN x < -0.3 THEN 'male' ELSE 'female' END AS sex FROM (SELECT sample, avg(l) FILTER (WHERE chr = 'chrX') AS x FROM cp GROUP BY 1)"),
    "cohort_recurrence": _with(_COHORT, f"SELECT bin_id, count(*) FILTER (WHERE l > 0.2) AS n_gain, count(*) FILTER (WHERE l < -0.2) AS n_loss, {_r('avg(l)', 'mean_log2')} FROM cp GROUP BY 1"),
    "cohort_loci": _with(
        _COHORT,
        f""", lo(locus, chr, pos) AS (VALUES {_LOCI}) SELECT locus, sample, {_r('round_even(l, 3)', 'log2', 3)}, count(*) FILTER (WHERE l > 0.2) OVER (PARTITION BY locus) AS n_gain, count(*) FILTER (WHERE l < -0.2) OVER (PARTITION BY locus) AS n_loss
        FROM lo JOIN cp ON cp.chr = lo.chr AND start <= pos AND pos < "end\"""",
    ),
    "barcode_match": _with(_REFS + _match("hm", "yr", "SELECT upper(substr(barcode, 9, 8)) AS half FROM obs"), "SELECT * FROM hm"),
    "barcode_match_two": _with(_REFS + _match("hm", "xr", "SELECT upper(substr(barcode, 1, 8)) AS half FROM obs", 2), "SELECT * FROM hm"),
    "barcode_status": _with(_MATCH, "SELECT full_status, count(*) AS n_barcodes, sum(fragments)::BIGINT AS fragments FROM mp GROUP BY 1"),
    "matched_barcodes": _with(
        _MATCH,
        "SELECT bc AS barcode_obs, fragments, x_status, y_status, full_status, CASE WHEN full_status = 'mapped' THEN xb || yb END AS barcode_mapped, xi AS \"X_ref_index\", yi AS \"Y_ref_index\", x_id, y_id FROM mp",
    ),
    "axis_marginals": _with(
        _MATCH, "SELECT xr.ref_index, code, load_order, true_order AS x_id, coalesce(f, 0)::BIGINT AS fragments FROM xa JOIN xr USING (ref_index) LEFT JOIN (SELECT xb, sum(fragments) AS f FROM mp WHERE full_status = 'mapped' GROUP BY 1) ON xb = code"
    ),
    "all_marginals": _with(_MATCH, "SELECT yb AS y_barcode, yi AS \"Y_ref_index\", sum(fragments)::BIGINT AS fragments, max(y_id) AS y_id FROM mp WHERE full_status = 'mapped' GROUP BY yb, yi"),
    "spot_matrix_pivot": _with(_MATCH, "SELECT i::INT AS x_id, " + ", ".join(f"coalesce(sum(fragments) FILTER (WHERE y_id = {k}), 0)::BIGINT AS y{k}" for k in range(1, 51)) + " FROM range(1, 51) t(i) LEFT JOIN crop ON x_id = i GROUP BY i"),
    "mapping_summary": _with(
        _MATCH,
        f"""SELECT (SELECT count(*) FROM obs) AS total_spot_barcodes_input, (SELECT sum(fragments)::BIGINT FROM obs) AS total_fragments_input, (SELECT count(*) FROM mp WHERE full_status = 'mapped') AS mapped_spot_barcodes_all_refs,
        (SELECT coalesce(sum(fragments), 0)::BIGINT FROM mp WHERE full_status = 'mapped') AS mapped_fragments_all_refs, count(*) AS cropped_spot_barcodes, coalesce(sum(fragments), 0)::BIGINT AS cropped_fragments,
        {_r('coalesce(avg(fragments), 0)', 'mean_fragments_per_cropped_spot')}, {_r('coalesce(median(fragments), 0)', 'median_fragments_per_cropped_spot')} FROM crop""",
    ),
    "fragment_semi_filter": _with(
        _MATCH, "SELECT 'chr1' || chr(9) || '5' || chr(9) || '9' || chr(9) || barcode || chr(9) || '60' AS value FROM obs WHERE upper(trim(barcode)) IN (SELECT bc FROM mp WHERE full_status = 'mapped' AND x_id IS NOT NULL AND y_id IS NOT NULL)"
    ),
    "barcode_extract": _with(_PAIRS + _FIXED, "SELECT ord, drop_reason, CASE WHEN drop_reason IS NULL THEN barcode END AS barcode, CASE WHEN drop_reason IS NULL THEN g::INT END AS g_len FROM exd"),
    "barcode_extract_anchored": _with(_PAIRS + _ANCHOR, "SELECT ord, drop_reason, CASE WHEN drop_reason IS NULL THEN barcode END AS barcode, CASE WHEN drop_reason IS NULL THEN g::INT END AS g_len FROM exa"),
    "linker_find": _with(
        _PAIRS + _ANCHOR,
        f"SELECT lp.ord, pos, coalesce(f, FALSE) AS passes FROM lp LEFT JOIN (SELECT ord, bool_or(hamming(rpad(substr(substr(s1, 1, 85), i + 1, 18), 18, '-'), '{LINKER}') <= 3) AS f FROM pr, range(0, 68) t(i) WHERE i <= least(85, length(s1)) - 18 GROUP BY 1) q ON q.ord = lp.ord",
    ),
    "barcode_counts_topk": _with(_PAIRS + _ANCHOR, 'SELECT barcode, count(*) AS "count" FROM exa WHERE drop_reason IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20'),
    "drop_stats": _with(
        _PAIRS + _ANCHOR,
        """, one AS (SELECT count(*) AS t, count(*) FILTER (WHERE drop_reason IS NULL) AS k, count(DISTINCT barcode) FILTER (WHERE drop_reason IS NULL) AS u FROM exa)
        SELECT 'total_pairs' AS metric, t::VARCHAR AS value FROM one UNION ALL SELECT 'kept_pairs', k::VARCHAR FROM one UNION ALL SELECT 'dropped_pairs', (t - k)::VARCHAR FROM one UNION ALL SELECT 'unique_barcodes', u::VARCHAR FROM one
        UNION ALL SELECT 'kept_fraction', printf('%.4f', k / t::DOUBLE) FROM one UNION ALL SELECT 'dropped_' || drop_reason, count(*)::VARCHAR FROM exa WHERE drop_reason IS NOT NULL GROUP BY drop_reason""",
    ),
    "read_names": _with(
        _PAIRS + _ANCHOR,
        "SELECT '@r' || ord || '_CB=' || barcode || '/1' || chr(10) || substr(s1, 106 + pos) || chr(10) || '+' || chr(10) || repeat('I', g) AS r1, '@r' || ord || '_CB=' || barcode || '/2' || chr(10) || s2 || chr(10) || '+' || chr(10) || repeat('I', length(s2)) AS r2 FROM exa WHERE drop_reason IS NULL",
    ),
    "cb_regex_counts": _with(_SAM, "SELECT regexp_extract(qname, 'CB=([A-Z]+)', 1) AS barcode, count(*) AS fragments FROM q30 WHERE flag & 67 = 67 AND regexp_matches(qname, 'CB=[A-Z]+') GROUP BY 1"),
    "fragment_projection": _with(
        _SAM, "SELECT chr, pos - 1 AS start, pos - 1 + abs(tlen) AS \"end\", CASE WHEN regexp_matches(qname, 'CB=[A-Z]+') THEN regexp_extract(qname, 'CB=([A-Z]+)', 1) ELSE 'NA' END AS cb, mapq FROM q30 WHERE flag & 67 = 67"
    ),
    "fragment_length_hist": _with(_SAM, 'SELECT abs(tlen) AS length, count(*) AS "count" FROM sam WHERE flag & 2 = 2 AND abs(tlen) > 0 AND abs(tlen) <= 1000 GROUP BY 1'),
    "cut_sites": _with(_SAM, 'SELECT chr, start, start + 1 AS "end", strand FROM cut'),
    "tss_bed": _with(_SAM, 'SELECT chr, start, "end" FROM tss'),
    "tss_profile": _with(_SAM, 'SELECT "offset"::INT AS "offset", count AS "count" FROM tp'),
    "tss_enrichment": _with(
        _SAM, f"SELECT {_r('avg(count) FILTER (WHERE \"offset\" BETWEEN -50 AND 50) / nullif(avg(count) FILTER (WHERE \"offset\" BETWEEN -2000 AND -1500 OR \"offset\" BETWEEN 1500 AND 2000), 0)', 'tss_enrichment')} FROM tp"
    ),
    "frip": _with(
        _SAM + ", pk AS (SELECT 'chr' || c AS chr, k * 500000 + 1000 AS s, k * 500000 + 21000 + k * 100 AS e FROM range(1, 23) t(c), range(100) u(k))",
        f"SELECT t AS total_reads, p AS in_peak_reads, {_r('p / t::DOUBLE', 'frip')} FROM (SELECT count(*) AS t, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pk WHERE pk.chr = al.chr AND al.start < e AND s < al.\"end\")) AS p FROM al)",
    ),
    "bin_gc_from_sequence": _with(
        f"sq AS (SELECT 'chr' || (o_custkey % 22 + 1) AS chr, o_orderkey % 9 AS bin, {_dna('o_orderkey')} || CASE WHEN o_orderkey % 2 = 0 THEN 'NNnnacgt' ELSE 'GG' END AS seq FROM orders)",
        f"SELECT chr, bin, {_r('coalesce(sum(g) / nullif(sum(n), 0)::DOUBLE, 0)', 'gc')}, sum(n)::BIGINT AS n_acgt FROM (SELECT chr, bin, len(regexp_extract_all(seq, '[GCgc]')) AS g, len(regexp_extract_all(seq, '[ACGTacgt]')) AS n FROM sq) GROUP BY ALL",
    ),
    "calinski_harabasz": _with(
        _VEC
        + """, vb AS (SELECT label, i, count(*) AS c, sum(x) AS s, sum(x * x) AS q FROM vec GROUP BY ALL), vt AS (SELECT i, sum(s) / sum(c) AS m, sum(c) AS n FROM vb GROUP BY 1),
        vs AS (SELECT count(DISTINCT label) AS k, max(n)::BIGINT AS n, sum(c * (s / c - m) * (s / c - m)) AS b, sum(q - s * s / c) AS w FROM vb JOIN vt USING (i))""",
        f"SELECT k, n, {_r('(b / (k - 1)) / (w / (n - k))', 'ch', 4)} FROM vs",
    ),
    "knn_vectors": f"""SELECT src, dst, rank::INT AS rank, {_r('d', 'dist2', 5)} FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM (
        SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM embeddings a, embeddings b)) WHERE rank <= 5""",
    "pc_double_smooth": _with(_POINTS, f"SELECT src AS spot_id, i::INT AS i, {_r('avg(x)', 'value', 5)} FROM px JOIN p1 ON p1.spot_id = dst GROUP BY src, i"),
    "adjusted_rand_index": f"""WITH p AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS b FROM orders),
        c AS (SELECT a, b, count(*) AS c FROM p GROUP BY ALL), x AS (SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS x, sum(c)::DOUBLE AS n FROM c),
        l AS (SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS l FROM (SELECT sum(c) AS c FROM c GROUP BY a)), r AS (SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS r FROM (SELECT sum(c) AS c FROM c GROUP BY b))
        SELECT {_r('(x - l * r / (n * (n - 1) / 2)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2))', 'ari')} FROM x, l, r""",
}
