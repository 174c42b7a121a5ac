"""SQL texts for queries whose results come from dynamic programming: edit scripts, forced alignment, segments.

They are plain recursive queries, written apart from the operators they are held against.
"""

from __future__ import annotations

#: DuckDB's levenshtein works on bytes: letters beyond ASCII become single bytes that normalised text cannot hold.
_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()"


def distance(a: str, b: str) -> str:
    """Edit distance of two normalised texts in code points."""
    plain = lambda x: f"translate({x}, '{_LETTERS}', '{_BYTES}')"
    return f"levenshtein({plain(a)}, {plain(b)})"


def rounded(x: str) -> str:
    """Three digits, rounded from the exact binary value."""
    return f"printf('%.3f', ({x})::DOUBLE)::DOUBLE"


def edits(pairs: str, name: str = "ed") -> str:
    """CTEs for the edit scripts of ``pairs`` (id, a, b: lists): ``name`` (id, dist, dels, ins, reps, first, last), the last two being the numbers, from 1, of the first and last kept element of a, 0 for none.

    Costs are worked out along diagonals. A cell is one number with its cost and, of the script that reaches it (keeping or replacing before deleting
    before inserting), the counts and the first and last kept element, 12 bits each.
    """
    big = "(16000::BIGINT << 48)"
    return f"""
    {name}_p AS (SELECT id, list_transform(a, lambda x: hash(x)) AS a, list_transform(b, lambda x: hash(x)) AS b, len(a) AS n, len(b) AS m FROM {pairs}),
    {name}_d AS (
      SELECT id, 0::BIGINT AS d, [0::BIGINT] AS cur, []::BIGINT[] AS prev, n, m FROM {name}_p
      UNION ALL
      SELECT x.id, d + 1, list_transform(range(0, d + 2), lambda i: CASE
          WHEN i > x.n OR d + 1 - i > x.m THEN {big}
          WHEN i = 0 THEN ((d + 1) << 48) + ((d + 1) << 24)
          WHEN i = d + 1 THEN ((d + 1) << 48) + ((d + 1) << 36)
          WHEN a[i] = b[d + 1 - i] AND prev[i] >> 48 <= least(cur[i] >> 48, cur[i + 1] >> 48) + 1 THEN
            (CASE WHEN (prev[i] >> 12) & 4095 = 0 THEN prev[i] - (prev[i] & 4095) + (i << 12) + i ELSE prev[i] - (prev[i] & 4095) + i END)
          WHEN a[i] <> b[d + 1 - i] AND prev[i] >> 48 <= least(cur[i] >> 48, cur[i + 1] >> 48) THEN prev[i] + (1::BIGINT << 48)
          WHEN cur[i] >> 48 <= cur[i + 1] >> 48 THEN cur[i] + (1::BIGINT << 48) + (1::BIGINT << 36)
          ELSE cur[i + 1] + (1::BIGINT << 48) + (1::BIGINT << 24) END), cur, x.n, x.m
      FROM {name}_d x JOIN {name}_p y ON x.id = y.id WHERE d < x.n + x.m),
    {name} AS (SELECT id, e >> 48 AS dist, (e >> 36) & 4095 AS dels, (e >> 24) & 4095 AS ins, (e >> 48) - ((e >> 36) & 4095) - ((e >> 24) & 4095) AS reps, (e >> 12) & 4095 AS first, e & 4095 AS last
      FROM (SELECT id, cur[n + 1] AS e FROM {name}_d WHERE d = n + m))"""


#: Turns as reference lines and the words said, as the queries make them. {w}: the words of a turn.
LINES = """
    ln AS (SELECT conv_id AS rec, turn AS line, printf('c%d_%d', conv_id, turn) AS id, coalesce(text, '') AS text, w FROM ({words})),
    u AS (SELECT rec, line, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ln),
    sd AS (SELECT rec, line, word, row_number() OVER (PARTITION BY rec ORDER BY line, i) - 1 AS pos FROM u),
    tm AS (SELECT *, pos * 0.5::DOUBLE AS start, pos * 0.5::DOUBLE + 0.25 AS stop FROM sd),
    al AS (SELECT * FROM tm WHERE pos % 31 <> 5),
    re AS (SELECT rec, pos, CASE WHEN pos % 7 = 0 THEN word || 'x' ELSE word END AS word, start, stop FROM tm WHERE pos % 10 <> 3)"""


def _unaligned(rows: str, gap: float) -> str:
    """Segments of words that belong to nothing: ``un`` (rec, reco, start, stop)."""
    return f"""
    ug AS (SELECT *, CASE WHEN start - lag(stop) OVER w > {gap} THEN 1 ELSE 0 END AS new FROM {rows} WINDOW w AS (PARTITION BY rec ORDER BY start, pos)),
    uh AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY start, pos ROWS UNBOUNDED PRECEDING) AS g FROM ug),
    un AS (SELECT rec, string_agg(word, ' ' ORDER BY start, pos) AS reco, min(start) AS start, max(stop) AS stop FROM uh GROUP BY rec, g)"""


def _by_lines(words: str, worst: str) -> str:
    """``sg``: segments of lines (rec, line, id, text, norm, reco, start, stop, n, dels, ins, reps, num, wer, cer, bad), and ``un``."""
    return f"""WITH RECURSIVE {LINES.format(words=words)},
    sp AS (SELECT rec, line, list(word ORDER BY start, pos) AS norm_w, min(start) AS b, max(stop) AS f, count(*) AS n FROM al GROUP BY rec, line),
    ho AS (SELECT re.*, sp.line FROM re JOIN sp ON re.rec = sp.rec AND (re.start + re.stop) / 2 BETWEEN b AND f),
    he AS (SELECT rec, line, list(word ORDER BY start, pos) AS reco_w FROM ho GROUP BY rec, line),
    pr AS (SELECT sp.rec || '_' || sp.line AS id, norm_w AS a, reco_w AS b FROM sp JOIN he USING (rec, line)),
    {edits('pr')},
    er AS (SELECT rec, line, norm_w, reco_w, sp.b, f, sp.n, dels, ins, reps, greatest(sp.n, 1) AS num, {rounded('dist / greatest(sp.n, 1)')} AS wer,
        {rounded(distance("array_to_string(norm_w, ' ')", "array_to_string(reco_w, ' ')") + " / greatest(length(array_to_string(norm_w, ' ')), 1)")} AS cer
      FROM sp LEFT JOIN he USING (rec, line) LEFT JOIN ed ON ed.id = rec || '_' || line),
    sg AS (SELECT ln.rec, ln.line, ln.id, ln.text, norm_w, reco_w, b, f, n, dels, ins, reps, num, wer, cer, reco_w IS NOT NULL AND cer >= {worst} AS bad FROM ln LEFT JOIN er USING (rec, line)),
    fr AS (SELECT re.rec, re.pos, re.word, re.start, re.stop FROM re WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.rec = re.rec AND (re.start + re.stop) / 2 BETWEEN b AND f)
      UNION ALL SELECT ho.rec, ho.pos, ho.word, ho.start, ho.stop FROM ho JOIN sg ON sg.rec = ho.rec AND sg.line = ho.line WHERE sg.bad),
    {_unaligned('fr', 2.0)}"""


def resegment_lines(words: str) -> str:
    return f"""{_by_lines(words, "'Infinity'::DOUBLE")}
,
    r AS (SELECT rec, line, id, array_to_string(norm_w, ' ') AS norm, array_to_string(reco_w, ' ') AS reco, b AS start, f AS "end", n AS n_words,
      CASE WHEN reco_w IS NOT NULL THEN wer END AS wer, CASE WHEN reco_w IS NOT NULL THEN cer END AS cer, CASE WHEN norm_w IS NULL THEN 'only in reference' END AS match_error FROM sg
      UNION ALL SELECT rec, NULL, NULL, NULL, reco, start, stop, NULL, NULL, NULL, 'only in reco' FROM un)
    SELECT * EXCLUDE (line), row_number() OVER (PARTITION BY rec ORDER BY coalesce(start, 0), line NULLS LAST, "end") - 1 AS place FROM r"""


def segment_stats(words: str) -> str:
    n = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
    return f"""{_by_lines(words, "0.5")},
    s AS (SELECT rec, CASE WHEN norm_w IS NULL OR bad THEN 'ref' ELSE 'ok' END AS kind, CASE WHEN norm_w IS NULL OR bad THEN {n} ELSE sg.n END AS words, CASE WHEN reco_w IS NOT NULL AND NOT bad THEN num END AS num, CASE WHEN reco_w IS NOT NULL AND NOT bad THEN dels + reps END AS wrong FROM sg
      UNION ALL SELECT rec, 'reco', len(string_split(reco, ' ')), NULL, NULL FROM un)
    SELECT rec, count(*) FILTER (kind = 'ref') AS ref_only_seg, coalesce(sum(words) FILTER (kind = 'ref'), 0)::BIGINT AS ref_only_words,
      count(*) FILTER (kind = 'reco') AS reco_only_seg, coalesce(sum(words) FILTER (kind = 'reco'), 0)::BIGINT AS reco_only_words,
      count(*) FILTER (kind = 'ok') AS ok_match_seg, coalesce(sum(words) FILTER (kind = 'ok'), 0)::BIGINT AS ok_match_words,
      CASE WHEN coalesce(sum(num), 0) > 0 THEN round(100 * sum(wrong) / sum(num), 2) ELSE 0.0 END AS overall_wer FROM s GROUP BY rec"""


def silence_segments(words: str, gap: float, longest: float) -> str:
    part = f"CASE WHEN o.span > {longest} AND o.stop - k.b > o.span / ceil(o.span / {longest})"
    return f"""WITH RECURSIVE {LINES.format(words=words)},
    g AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY rec ORDER BY start, pos) > {gap} THEN 1 ELSE 0 END AS new FROM al),
    gr AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY start, pos ROWS UNBOUNDED PRECEDING) AS gno FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY rec, gno ORDER BY start, pos) AS k, max(stop) OVER (PARTITION BY rec, gno) - min(start) OVER (PARTITION BY rec, gno) AS span FROM gr),
    k AS (SELECT rec, gno, k, pos, word, start, stop, start AS b, 0 AS part FROM o WHERE k = 1
      UNION ALL SELECT o.rec, o.gno, o.k, o.pos, o.word, o.start, o.stop, {part} THEN o.start ELSE k.b END, {part} THEN k.part + 1 ELSE k.part END FROM k JOIN o ON o.rec = k.rec AND o.gno = k.gno AND o.k = k.k + 1),
    sp AS (SELECT rec, gno, part, list(word ORDER BY start, pos) AS norm_w, min(start) AS b, max(stop) AS f, count(*) AS n FROM k GROUP BY rec, gno, part),
    hits AS (SELECT re.*, gno, part, row_number() OVER (PARTITION BY re.rec, re.pos ORDER BY sp.b, gno, part) AS r FROM re JOIN sp ON re.rec = sp.rec AND (re.start BETWEEN b AND f OR re.stop BETWEEN b AND f)),
    he AS (SELECT rec, gno, part, list(word ORDER BY start, pos) AS reco_w FROM hits WHERE r = 1 GROUP BY rec, gno, part),
    all_ AS (SELECT rec, gno, part, norm_w, coalesce(reco_w, []::VARCHAR[]) AS reco_w, b, f, n FROM sp LEFT JOIN he USING (rec, gno, part)),
    pr AS (SELECT rec || '_' || gno || '_' || part AS id, norm_w AS a, reco_w AS b FROM all_),
    {edits('pr')},
    fr AS (SELECT re.* FROM re WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.rec = re.rec AND (re.start BETWEEN b AND f OR re.stop BETWEEN b AND f))),
    {_unaligned('fr', gap)},
    r AS (SELECT rec, array_to_string(norm_w, ' ') AS norm, array_to_string(reco_w, ' ') AS reco, b AS start, f AS "end", {rounded('dist / greatest(n, 1)')} AS wer,
        {rounded(distance("array_to_string(norm_w, ' ')", "array_to_string(reco_w, ' ')") + " / greatest(length(array_to_string(norm_w, ' ')), 1)")} AS cer, false AS unaligned
      FROM all_ JOIN ed ON ed.id = rec || '_' || gno || '_' || part
      UNION ALL SELECT rec, NULL, reco, start, stop, NULL, NULL, true FROM un)
    SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start, unaligned, "end") - 1 AS place FROM r"""


def best_windows(hits: str) -> str:
    """CTEs from those of the n-gram hits: ``pr`` (item_id, c, d), ``cand`` (item_id, beg, n, size, hits) and ``bw`` (item_id, beg, n, size, distance, said)."""
    return f"""{hits},
    pr AS (SELECT rk.item_id, it.w AS c, dw.w AS d FROM rk JOIN it USING (item_id) JOIN dw USING (doc_id) WHERE rank = 1),
    {nearest()}"""


def nearest() -> str:
    """CTEs from ``pr`` (item_id, c: words of a chunk, d: words of its corpus) to ``bw``."""
    return f"""
    h AS (SELECT item_id, len(c) AS n, len(d) AS size, unnest(list_transform(d, lambda x: CAST(list_contains(c, x) AS INT))) AS hit, generate_subscripts(d, 1) - 1 AS p FROM pr),
    cs AS (SELECT *, sum(hit) OVER (PARTITION BY item_id ORDER BY p) AS s FROM h),
    win AS (SELECT a.item_id, a.p AS beg, a.n, a.size, b.s - a.s + a.hit AS hits FROM cs a JOIN cs b ON a.item_id = b.item_id AND b.p = least(a.p + a.n, a.size) - 1 WHERE a.p < greatest(a.size - a.n + 1, 1)),
    near AS (SELECT *, max(hits) OVER (PARTITION BY item_id) AS best FROM win QUALIFY hits > 0 AND hits >= max(hits) OVER (PARTITION BY item_id) * 0.9),
    cand AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS found FROM near),
    tx AS (SELECT item_id, beg, cand.n, cand.size, array_to_string(c, ' ') AS said, array_to_string(d[beg + 1 : beg + cand.n], ' ') AS there FROM cand JOIN pr USING (item_id) WHERE found <= 1000 OR hits >= best * 0.99),
    ds AS (SELECT *, {distance('said', 'there')} AS distance FROM tx),
    bw AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, beg) = 1)"""


def window_errors(hits: str) -> str:
    return f"""WITH RECURSIVE {best_windows(hits)},
    wp AS (SELECT item_id AS id, d[beg + 1 : beg + n] AS a, c AS b FROM bw JOIN pr USING (item_id)),
    {edits('wp')},
    e AS (SELECT id AS item_id, dels AS "delete", ins AS "insert", reps AS "replace", greatest(len(a), 1) AS num, greatest(len(a), 1) - dels - reps AS corr, {rounded('dist / greatest(len(a), 1)')} AS wer,
        {rounded(distance("array_to_string(a, ' ')", "array_to_string(b, ' ')") + " / greatest(length(array_to_string(a, ' ')), 1)")} AS cer, CASE WHEN first > 0 THEN first - 1 END AS beg, CASE WHEN first > 0 THEN last END AS "end" FROM wp JOIN ed USING (id))
    SELECT *, CASE WHEN wer < 0.01 THEN 'perfect' WHEN wer < 0.1 THEN 'good' WHEN wer < 0.5 THEN 'mediocre' WHEN wer < 1 THEN 'bad' ELSE 'terrible' END AS bucket FROM e"""


def trims(pairs: str, least: int) -> str:
    """CTEs for the first and the last run of ``least`` kept elements of ``pairs`` (id, a, b: lists): ``ce`` (id, e: fa, fb, la, lb), elements from 1 on, 0 for none.

    As in ``edits``; a cell is its cost, how many elements before it were kept in a row, and where the first long run begins and the last one ends on both sides.
    """
    far = "{c: 16000, r: 0, fa: 0, fb: 0, la: 0, lb: 0}"
    edge = "{c: (d + 1)::INT, r: 0, fa: 0, fb: 0, la: 0, lb: 0}"
    step = lambda x: f"{{c: {x}.c + 1, r: 0, fa: {x}.fa, fb: {x}.fb, la: {x}.la, lb: {x}.lb}}"
    grown = f"prev[i].r + 1 >= {least}"
    begun = lambda c, at: f"{c}: CASE WHEN prev[i].r + 1 = {least} AND prev[i].fa = 0 THEN ({at} - {least - 1})::INT ELSE prev[i].{c} END"
    keep = f"{{c: prev[i].c, r: prev[i].r + 1, {begun('fa', 'i')}, {begun('fb', 'd + 1 - i')}, la: CASE WHEN {grown} THEN i::INT ELSE prev[i].la END, lb: CASE WHEN {grown} THEN (d + 1 - i)::INT ELSE prev[i].lb END}}"
    return f"""
    cp AS (SELECT id, a, b, len(a) AS n, len(b) AS m FROM {pairs}),
    cd AS (
      SELECT id, 0::BIGINT AS d, [{far.replace('16000', '0')}] AS cur, [{far}][1:0] AS prev FROM cp
      UNION ALL
      SELECT x.id, d + 1, list_transform(range(0, d + 2), lambda i: CASE
          WHEN i > n OR d + 1 - i > m THEN {far}
          WHEN i = 0 OR i = d + 1 THEN {edge}
          WHEN a[i] = b[d + 1 - i] THEN {keep}
          WHEN prev[i].c <= least(cur[i].c, cur[i + 1].c) THEN {step('prev[i]')}
          WHEN cur[i].c <= cur[i + 1].c THEN {step('cur[i]')}
          ELSE {step('cur[i + 1]')} END), cur
      FROM cd x JOIN cp y ON x.id = y.id WHERE d < n + m),
    ce AS (SELECT id, cur[n + 1] AS e FROM cd JOIN cp USING (id) WHERE d = n + m)"""


def char_trim(hits: str, least: int = 3) -> str:
    """The words between the first and the last run of ``least`` equal characters of each best window and its item."""
    return f"""WITH RECURSIVE {best_windows(hits)},
    wp AS (SELECT item_id AS id, array_to_string(d[beg + 1 : beg + n], ' ') AS ta, array_to_string(c, ' ') AS tb, len(d[beg + 1 : beg + n]) AS na, len(c) AS nb FROM bw JOIN pr USING (item_id)),
    lp AS (SELECT id, string_split(ta, '') AS a, string_split(tb, '') AS b FROM wp),
    {trims('lp', least)}
    SELECT id AS item_id, CASE WHEN e.fa > 0 THEN {_word('ta', 'e.fa', 'na')} END AS a_beg, CASE WHEN e.fa > 0 THEN {_word('ta', 'e.la', 'na')} + 1 END AS a_end,
      CASE WHEN e.fa > 0 THEN {_word('tb', 'e.fb', 'nb')} END AS b_beg, CASE WHEN e.fa > 0 THEN {_word('tb', 'e.lb', 'nb')} + 1 END AS b_end FROM ce JOIN wp USING (id)"""


def single_matches(turns: str, length: int, stride: int, worst: float) -> str:
    """The best windows of chunks of ``length`` words every ``stride`` words, nearer than ``worst``, cut to their first and last equal words. ``turns``: (conv_id, turn, w)."""
    return f"""WITH RECURSIVE tw AS (SELECT conv_id AS rec, turn, list_filter(w, lambda x: regexp_matches(x, '^[a-z]+$')) AS w FROM ({turns})),
    un AS (SELECT rec, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tw),
    nm AS (SELECT rec, word, row_number() OVER (PARTITION BY rec ORDER BY turn, i) - 1 AS pos FROM un),
    re AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS n, CASE WHEN (pos + rec) % 120 >= 108 THEN 'noise' WHEN pos % 7 = 0 THEN word || 'x' ELSE word END AS word, pos * 1.5::DOUBLE + (pos // 50) * 20.0 AS start FROM nm WHERE pos % 10 <> 3),
    li AS (SELECT rec, list(word ORDER BY n) AS said, list(start ORDER BY n) AS times FROM re GROUP BY rec),
    co AS (SELECT rec, list(word ORDER BY pos) AS read FROM nm GROUP BY rec),
    ch AS (SELECT rec, said, times, read, unnest(range(0, (len(said) + {stride - 1}) // {stride})) AS k FROM li JOIN co USING (rec)),
    pr AS (SELECT rec || '_' || k AS item_id, said[k * {stride} + 1 : k * {stride} + {length}] AS c, read AS d, rec, k, said, times FROM ch),
    {nearest()},
    ok AS (SELECT item_id AS id, c AS a, d[beg + 1 : beg + bw.n] AS b, beg, rec, k, pr.said AS said, times, d FROM bw JOIN pr USING (item_id) WHERE distance / length(bw.said) <= {worst}),
    {trims('ok', 1)},
    fi AS (SELECT rec, k * {stride} + e.fa - 1 AS reco_beg, k * {stride} + e.la AS reco_end, beg + e.fb - 1 AS norm_beg, beg + e.lb AS norm_end, said, times, d FROM ce JOIN ok USING (id) WHERE e.fa > 0),
    tx2 AS (SELECT rec, reco_beg, reco_end, norm_beg, norm_end, array_to_string(d[norm_beg + 1 : norm_end], ' ') AS ref_text, array_to_string(said[reco_beg + 1 : reco_end], ' ') AS reco_text, times[reco_beg + 1] AS start, times[reco_end] + 1.25 AS "end" FROM fi)
    SELECT *, round({distance('ref_text', 'reco_text')} / length(ref_text), 9) AS cer FROM tx2"""


def _word(text: str, at: str, words: str) -> str:
    """Number of the word that holds or follows character ``at``, counted from 1."""
    return f"least(length({text}[1:{at}]) - length(replace({text}[1:{at}], ' ', '')), {words} - 1)::INT"


#: Fifty vectors make a recording, their components the scores of the labels 4 1 2 4 3 5 4. A state's cell is its score and the frames at which the states up to it were entered.
VITERBI = """WITH RECURSIVE f AS (SELECT vec_id // 50 AS rec, vec_id % 50 AS t, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    sz AS (SELECT rec, count(*) AS n FROM f GROUP BY rec),
    v AS (SELECT rec, 0::BIGINT AS t, n, [x[1]] || list_transform(range(0, 6), lambda i: '-Infinity'::DOUBLE) AS sc, list_transform(range(0, 7), lambda i: []::BIGINT[]) AS ent FROM f JOIN sz USING (rec) WHERE t = 0 AND n >= 7
      UNION ALL SELECT v.rec, v.t + 1, v.n,
        list_transform(range(1, 8), lambda i: CASE WHEN i - 1 < v.t + 1 - v.n + 7 OR i - 1 >= v.t + 2 THEN '-Infinity'::DOUBLE WHEN i > 1 AND sc[i - 1] > sc[i] THEN sc[i - 1] + x[[5, 2, 3, 5, 4, 6, 5][i]] ELSE sc[i] + x[1] END),
        list_transform(range(1, 8), lambda i: CASE WHEN i > 1 AND sc[i - 1] > sc[i] THEN list_append(ent[i - 1], v.t + 1) ELSE ent[i] END)
      FROM v JOIN f ON f.rec = v.rec AND f.t = v.t + 1),
    z AS (SELECT rec, ent[7] AS e FROM v WHERE t = n - 1)
    SELECT rec, 0 AS pos, 'ab' AS word, e[1] * 0.02::DOUBLE AS start, e[3] * 0.02::DOUBLE AS "end" FROM z
    UNION ALL SELECT rec, 1, 'ce', e[4] * 0.02::DOUBLE, e[6] * 0.02::DOUBLE FROM z"""
