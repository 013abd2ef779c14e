"""Oracle SQL (DuckDB) for the eval set: brute force — every (eval, attempt, role) predicate
row is tested against every patient, then resolved and formatted per class."""

from __future__ import annotations

from cohortsmith import constants as K
from cohortsmith.functions.draws import cumulative_thresholds

from .cohort_sql import cohort_ctes, dbl, draw, lst, s

ATT = range(K.NON_EMPTY_ATTEMPTS)


def u(name: str) -> str:
    return draw("eval", name, key="eval_idx")


def idx(uexpr: str, n) -> str:
    return f"(floor({uexpr} * ({n})))::INTEGER"


def pk(uexpr: str, items) -> str:
    return f"list_extract({lst(items)}, {idx(uexpr, len(items))} + 1)"


def pk_list(uexpr: str, col: str) -> str:
    return f"list_extract({col}, {idx(uexpr, f'len({col})')} + 1)"


def pair(ua: str, ub: str, items) -> tuple[str, str]:
    n = len(items)
    a = idx(ua, n)
    b0 = idx(ub, n - 1)
    return (f"list_extract({lst(items)}, {a} + 1)",
            f"list_extract({lst(items)}, (CASE WHEN {b0} >= {a} THEN {b0} + 1 ELSE {b0} END) + 1)")


def between(uexpr: str, lo: int, hi: int) -> str:
    return f"({lo} + {idx(uexpr, hi - lo + 1)})"


def _class_expr() -> str:
    cum = cumulative_thresholds(K.QUERY_CLASS_WEIGHTS)
    total = cum[-1][1]
    roll = f"(u_class * {dbl(total)})"
    return "CASE " + " ".join(f"WHEN {roll} <= {dbl(c)} THEN {s(n)}" for n, c in cum) + \
        f" ELSE {s(K.QUERY_CLASS_WEIGHTS[0][0])} END"


def _draw_cols() -> str:
    names = ["class", "gender#0", "region#0", "drug_b#0", "unknown#0", "fake_id#0", "fallback", "pick"]
    for a in ATT:
        names += [f"variant#{a}", f"med#{a}", f"cond#{a}", f"cond_b#{a}", f"age_cut#{a}", f"rtype#{a}", f"drug#{a}"]
    return ", ".join(f"{u(n)} AS u_{n.replace('#', '_')}" for n in names)


SPEC_COLS = ["eval_idx", "qt", "attempt", "role", "kind", "value", "min_age", "max_age", "gender", "region", "cond2",
             "cond3", "severe", "reacted", "rtype", "query", "prefix"]


def spec(qt: str, attempt, role: str, kind: str, value: str = "''", where: str = "TRUE", **kw) -> str:
    vals = {"eval_idx": "eval_idx", "qt": s(qt), "attempt": str(attempt), "role": s(role), "kind": s(kind),
            "value": value}
    types = {"min_age": "INTEGER", "max_age": "INTEGER", "severe": "BOOLEAN", "reacted": "BOOLEAN"}
    out = []
    for c in SPEC_COLS:
        if c in vals:
            out.append(f"{vals[c]} AS {c}")
        elif c in kw:
            out.append(f"CAST({kw[c]} AS {types.get(c, 'VARCHAR')}) AS {c}")
        elif c in ("severe", "reacted"):
            out.append(f"FALSE AS {c}")
        else:
            out.append(f"CAST(NULL AS {types.get(c, 'VARCHAR')}) AS {c}")
    return f"SELECT {', '.join(out)} FROM evp WHERE qt = {s(qt)} AND ({where})"


def _specs() -> str:
    rows = []
    for a in ATT:  # Lookup
        med = pk(f"u_med_{a}", K.REACTION_DRUGS)
        var = idx(f"u_variant_{a}", 3)
        eff = f"(CASE WHEN {var} = 2 AND len(rtypes) = 0 THEN 0 ELSE {var} END)"
        rt = pk_list(f"u_rtype_{a}", "rtypes")
        q = (f"CASE WHEN {eff} = 0 THEN printf('Which patients had a reaction to %s?', {med}) "
             f"WHEN {eff} = 1 THEN printf('Which patients had a severe reaction to %s?', {med}) "
             f"ELSE printf('Which patients experienced %s after taking %s?', {rt}, {med}) END")
        rows.append(spec("Lookup", a, "main", "rx", med, severe=f"{eff} = 1", rtype=f"CASE WHEN {eff} = 2 THEN {rt} END",
                         query=q))
    for a in ATT:  # MultiHop
        med = pk(f"u_med_{a}", K.REACTION_DRUGS)
        var = idx(f"u_variant_{a}", 3)
        cond = pk(f"u_cond_{a}", K.CONDITIONS)
        ca, cb = pair(f"u_cond_{a}", f"u_cond_b_{a}", K.CONDITIONS)
        mn = between(f"u_age_cut_{a}", 45, 70)
        rows.append(spec("MultiHop", a, "main", "rx", med, f"{var} = 0", cond2=cond,
                         query=f"printf('Among %s patients prescribed %s, how many had an adverse reaction?', {cond}, {med})",
                         prefix=f"printf('%s, %s, reaction, ', {cond}, {med})"))
        rows.append(spec("MultiHop", a, "main", "med", med, f"{var} = 1", cond2=ca, cond3=cb,
                         query=f"printf('Among patients with both %s and %s, how many were prescribed %s?', {ca}, {cb}, {med})",
                         prefix=f"printf('%s + %s, prescribed %s, ', {ca}, {cb}, {med})"))
        rows.append(spec("MultiHop", a, "main", "rx", med, f"{var} = 2", severe="TRUE", min_age=mn, cond2=cond,
                         query=f"printf('How many patients over %d with %s had a severe reaction to %s?', {mn}, {cond}, {med})",
                         prefix=f"printf('age > %d, %s, severe reaction to %s, ', {mn}, {cond}, {med})"))
    # FilteredLookup
    med = pk("u_med_0", K.REACTION_DRUGS)
    var = idx("u_variant_0", 4)
    eff = f"(CASE WHEN {var} = 1 AND len(regions) = 0 THEN 3 ELSE {var} END)"
    mn, mx = between("u_age_cut_0", 50, 75), between("u_age_cut_0", 40, 65)
    g = "(CASE WHEN u_gender_0 < 0.5::DOUBLE THEN 'Female' ELSE 'Male' END)"
    reg = pk_list("u_region_0", "regions")
    cond = pk("u_cond_0", K.CONDITIONS)
    tail = f"', medication ' || {med} || ', '"
    rows.append(spec("FilteredLookup", 0, "main", "rx", med, f"{eff} = 0", min_age=mn, gender=g,
                     query=f"printf('Which %s patients over %d had a reaction to %s?', lower({g}), {mn}, {med})",
                     prefix=f"printf('age > %d, gender %s', {mn}, lower({g})) || {tail}"))
    rows.append(spec("FilteredLookup", 0, "main", "rx", med, f"{eff} = 1", region=reg,
                     query=f"printf('Which patients in the %s region had a reaction to %s?', {reg}, {med})",
                     prefix=f"'region ' || {reg} || {tail}"))
    rows.append(spec("FilteredLookup", 0, "main", "rx", med, f"{eff} = 2", cond2=cond,
                     query=f"printf('Which patients with %s had a reaction to %s?', {cond}, {med})",
                     prefix=f"'comorbidity ' || {cond} || {tail}"))
    rows.append(spec("FilteredLookup", 0, "main", "rx", med, f"{eff} = 3", severe="TRUE", max_age=mx,
                     query=f"printf('Which patients under %d had a severe reaction to %s?', {mx}, {med})",
                     prefix=f"printf('age < %d, severity Severe', {mx}) || {tail}"))
    # Aggregation
    var = idx("u_variant_0", 5)
    drug = pk("u_drug_0", K.ALL_DRUGS)
    rows.append(spec("Aggregation", 0, "main", "rx", med, f"{var} = 0",
                     query=f"printf('What percentage of %s patients had an adverse reaction?', {med})", prefix=med))
    rows.append(spec("Aggregation", 0, "c1", "med", med, f"{var} = 0"))
    rows.append(spec("Aggregation", 0, "c2", "rx", med, f"{var} = 0", severe="TRUE"))
    rows.append(spec("Aggregation", 0, "main", "med", drug, f"{var} = 1",
                     query=f"printf('How many patients were prescribed %s?', {drug})", prefix=drug))
    rows.append(spec("Aggregation", 0, "main", "cond", cond, f"{var} = 2",
                     query=f"printf('What is the average age of patients with %s?', {cond})", prefix=cond))
    rows.append(spec("Aggregation", 0, "main", "cond", cond, f"{var} = 3", severe="TRUE",
                     query=f"printf('How many patients with %s had a severe adverse reaction?', {cond})", prefix=cond))
    rows.append(spec("Aggregation", 0, "main", "cond", cond, f"{var} = 4", gender=g,
                     query=f"printf('How many %s patients have %s?', lower({g}), {cond})",
                     prefix=f"lower({g}) || ' ' || {cond}"))
    # Negative
    var = idx("u_variant_0", 4)
    ud, uc, nd = pk("u_unknown_0", K.UNKNOWN_DRUGS), pk("u_unknown_0", K.UNKNOWN_CONDITIONS), pk("u_drug_0", K.ALL_DRUGS)
    fake = f"printf('P%09d', {K.FAKE_ID_BASE} + {idx('u_fake_id_0', K.FAKE_ID_SPAN)})"
    rows.append(spec("Negative", 0, "probe", "med", ud, f"{var} = 0",
                     query=f"printf('Which patients had a reaction to %s?', {ud})"))
    rows.append(spec("Negative", 0, "probe", "cond", uc, f"{var} = 1",
                     query=f"printf('Which patients were diagnosed with %s?', {uc})"))
    rows.append(spec("Negative", 0, "probe", "rx", nd, f"{var} = 2",
                     query=f"printf('Which patients had a documented reaction to %s?', {nd})"))
    rows.append(spec("Negative", 0, "probe", "id", fake, f"{var} = 3",
                     query=f"printf('What medications was patient %s prescribed?', {fake})"))
    # Comparative
    var = idx("u_variant_0", 4)
    da, db = pair("u_drug_0", "u_drug_b_0", K.ALL_DRUGS)
    ca, cb = pair("u_cond_0", "u_cond_b_0", K.CONDITIONS)
    cut = between("u_age_cut_0", 40, 70)
    rows.append(spec("Comparative", 0, "main", "rx", da, f"{var} = 0", prefix=da,
                     query=f"printf('Was %s or %s associated with more adverse reactions?', {da}, {db})"))
    rows.append(spec("Comparative", 0, "b", "rx", db, f"{var} = 0", prefix=db))
    rows.append(spec("Comparative", 0, "main", "cond", ca, f"{var} = 1", prefix=ca,
                     query=f"printf('Which is more common in the cohort: %s or %s?', {ca}, {cb})"))
    rows.append(spec("Comparative", 0, "b", "cond", cb, f"{var} = 1", prefix=cb))
    rows.append(spec("Comparative", 0, "main", "cond", cond, f"{var} = 2", reacted="TRUE", prefix=cond,
                     query=f"printf('Do patients with %s have a higher adverse reaction rate than those without?', {cond})"))
    rows.append(spec("Comparative", 0, "c1", "cond", cond, f"{var} = 2"))
    rows.append(spec("Comparative", 0, "main", "rx", med, f"{var} = 3", prefix=med, max_age=f"NULL",
                     query=f"printf('Which age group had more reactions to %s: patients under %d or %d and older?', "
                           f"{med}, {cut}, {cut})"))
    rows.append(spec("Comparative", 0, "c1", "rx", med, f"{var} = 3", max_age=cut))
    # EvidenceRetrieval: tries 0..2 then every patient
    v0 = idx("u_variant_0", 3)
    for off in range(3):
        v = f"(({v0} + {off}) % 3)"
        emed, econd, edrug = (pk(f"u_med_{off}", K.REACTION_DRUGS), pk(f"u_cond_{off}", K.CONDITIONS),
                              pk(f"u_drug_{off}", K.ALL_DRUGS))
        rows.append(spec("EvidenceRetrieval", off, "pool", "rx", emed, f"{v} = 0",
                         query=f"'reaction to ' || {emed}", prefix=f"{emed} || ' reaction'"))
        rows.append(spec("EvidenceRetrieval", off, "pool", "cond", econd, f"{v} = 1",
                         query=f"'diagnosis of ' || {econd}", prefix=f"'comorbidity ' || {econd}"))
        rows.append(spec("EvidenceRetrieval", off, "pool", "med", edrug, f"{v} = 2",
                         query=f"'prescription of ' || {edrug}", prefix=f"'medication ' || {edrug}"))
    rows.append(spec("EvidenceRetrieval", 3, "pool", "all", query="'this patient''s history'",
                     prefix="'patient record'"))
    return "\nUNION ALL ".join(rows)


def _one(x: str) -> str:
    return f"printf('%.1f', {x})"


def _rate(r: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE ({r})::DOUBLE / ({n})::DOUBLE * 100.0::DOUBLE END)"


def _cmp(a, an, b, bn, noun):
    return (f"CASE WHEN {an} > {bn} THEN printf('%s (%d {noun} vs %d for %s)', {a}, {an}, {bn}, {b}) "
            f"WHEN {bn} > {an} THEN printf('%s (%d {noun} vs %d for %s)', {b}, {bn}, {an}, {a}) "
            f"ELSE printf('Equal (%d {noun} each)', {an}) END")


MATCH = ("((sp.kind = 'rx' AND p.allergic_reaction AND p.reaction_medication = sp.value) "
         "OR (sp.kind = 'med' AND list_contains(p.medications, sp.value)) "
         "OR (sp.kind = 'cond' AND list_contains(p.comorbidities, sp.value)) "
         "OR (sp.kind = 'id' AND p.patient_id = sp.value) OR sp.kind = 'all') "
         "AND (sp.min_age IS NULL OR p.age > sp.min_age) AND (sp.max_age IS NULL OR p.age < sp.max_age) "
         "AND (sp.gender IS NULL OR p.gender = sp.gender) AND (sp.region IS NULL OR p.region = sp.region) "
         "AND (sp.cond2 IS NULL OR list_contains(p.comorbidities, sp.cond2)) "
         "AND (sp.cond3 IS NULL OR list_contains(p.comorbidities, sp.cond3)) "
         "AND (NOT sp.severe OR p.reaction_severity = 'Severe') "
         "AND (sp.rtype IS NULL OR p.reaction_type = sp.rtype) AND (NOT sp.reacted OR p.allergic_reaction)")


def eval_set_sql() -> str:
    diff = "CASE qt " + " ".join(f"WHEN {s(c)} THEN {s(d)}" for c, d in K.CLASS_DIFFICULTY.items()) + " END"
    reaction = "'reaction ' || coalesce(p.reaction_type, 'unknown')"

    def role(r, col, att="0"):
        return f"max({col}) FILTER (WHERE role = {s(r)} AND attempt = {att})"

    return f"""WITH {cohort_ctes()[1:]},
pat AS (SELECT patient_key, patient_id, age, gender, region, comorbidities, medications, allergic_reaction,
    reaction_medication, reaction_type, reaction_severity, 'chunk_' || patient_id || '_note_0' AS chunk, note_text
  FROM cohort_n),
lists AS (SELECT list_sort(list_distinct(list(reaction_type) FILTER (WHERE reaction_type IS NOT NULL))) AS rtypes,
    list_sort(list_distinct(list(region))) AS regions, count(*)::BIGINT AS n_all,
    count_if(allergic_reaction)::BIGINT AS r_all FROM pat),
evd AS (SELECT c_custkey AS eval_idx, {_draw_cols()} FROM customer),
evp AS (SELECT evd.*, {_class_expr()} AS qt, lists.* FROM evd, lists),
spec AS ({_specs()}),
res AS (SELECT sp.eval_idx, sp.qt, sp.attempt, sp.role, sp.query, sp.prefix,
    count(p.patient_key)::BIGINT AS n, coalesce(sum(p.age), 0)::BIGINT AS sage,
    string_agg(p.patient_id, ', ' ORDER BY p.patient_key) AS ids,
    string_agg(p.patient_id || ' => ' || {reaction} || ', severity ' || coalesce('Some(' || p.reaction_severity || ')', 'None'),
               ' ; ' ORDER BY p.patient_key) AS flk,
    string_agg(p.patient_id || ' => ' || coalesce(sp.prefix, '') || {reaction}, ' ; ' ORDER BY p.patient_key) AS frx,
    string_agg(p.chunk, ',' ORDER BY p.patient_key) AS chunks,
    string_agg(p.note_text, chr(10) || chr(10) ORDER BY p.patient_key) AS texts,
    list(p.chunk ORDER BY p.patient_key) FILTER (WHERE p.patient_key IS NOT NULL) AS chunk_list,
    list(p.patient_id ORDER BY p.patient_key) FILTER (WHERE p.patient_key IS NOT NULL) AS members,
    list(p.note_text ORDER BY p.patient_key) FILTER (WHERE p.patient_key IS NOT NULL) AS notes
  FROM spec sp LEFT JOIN pat p ON {MATCH}
  GROUP BY ALL),
chosen AS (SELECT eval_idx, qt,
    CASE WHEN qt IN ('Lookup', 'MultiHop') THEN coalesce(min(attempt) FILTER (WHERE role = 'main' AND n > 0), 3)
         WHEN qt = 'EvidenceRetrieval' THEN min(attempt) FILTER (WHERE n > 0) ELSE 0 END AS att
  FROM res GROUP BY eval_idx, qt),
ev AS (SELECT c.eval_idx, c.qt, c.att,
    m.query AS q_main, m.prefix AS x_main, m.n AS n_main, m.sage AS s_main, m.ids AS ids_a, m.flk, m.frx, m.chunks AS chunks_a,
    coalesce(m.chunk_list, []) AS f_a, m.members, m.notes, m.texts AS texts_a, coalesce(m.notes, []) AS t_a,
    b.n AS n_b, b.ids AS ids_b, coalesce(b.chunk_list, []) AS f_b, coalesce(b.notes, []) AS t_b, b.prefix AS x_b,
    c1.n AS n_c1, c2.n AS n_c2, pr.n AS n_probe, pr.query AS q_probe
  FROM chosen c
  LEFT JOIN res m ON m.eval_idx = c.eval_idx AND m.attempt = c.att AND m.role IN ('main', 'pool')
  LEFT JOIN res b ON b.eval_idx = c.eval_idx AND b.role = 'b'
  LEFT JOIN res c1 ON c1.eval_idx = c.eval_idx AND c1.role = 'c1'
  LEFT JOIN res c2 ON c2.eval_idx = c.eval_idx AND c2.role = 'c2'
  LEFT JOIN res pr ON pr.eval_idx = c.eval_idx AND pr.role = 'probe'
  WHERE c.qt <> 'EvidenceRetrieval' OR c.att IS NOT NULL),
evx AS (SELECT ev.*, evp.u_pick, evp.u_variant_0, evp.u_fallback, evp.u_age_cut_0, evp.n_all, evp.r_all,
    {idx('evp.u_pick', 'ev.n_main')} + 1 AS pick_rank
  FROM ev JOIN evp ON evp.eval_idx = ev.eval_idx),
fmt AS (SELECT *,
    CASE qt
      WHEN 'Lookup' THEN q_main WHEN 'MultiHop' THEN q_main WHEN 'FilteredLookup' THEN q_main
      WHEN 'Aggregation' THEN q_main WHEN 'Comparative' THEN q_main
      WHEN 'Negative' THEN CASE WHEN n_probe > 0 THEN printf('Which patients had a reaction to %s?', {pk('u_fallback', K.UNKNOWN_DRUGS)}) ELSE q_probe END
      ELSE printf('Find the clinical note documenting the %s for patient %s.', q_main, members[pick_rank]) END AS query,
    {idx('u_variant_0', 5)} AS av, {idx('u_variant_0', 4)} AS cv, {between('u_age_cut_0', 40, 70)} AS cut
  FROM evx),
fin AS (SELECT *,
    CASE qt
      WHEN 'Lookup' THEN CASE WHEN n_main = 0 THEN 'None' ELSE ids_a END
      WHEN 'FilteredLookup' THEN CASE WHEN n_main = 0 THEN 'None' ELSE ids_a END
      WHEN 'MultiHop' THEN CAST(n_main AS VARCHAR)
      WHEN 'Aggregation' THEN CASE
          WHEN av = 0 THEN {_one(_rate('n_main', 'n_c1'))} || '% (' || CAST(n_main AS VARCHAR) || ' out of ' || CAST(n_c1 AS VARCHAR) || ' exposed)'
          WHEN av = 2 THEN CASE WHEN n_main = 0 THEN 'None' ELSE {_one('s_main::DOUBLE / n_main::DOUBLE')} END
          ELSE CAST(n_main AS VARCHAR) END
      WHEN 'Comparative' THEN CASE
          WHEN cv = 0 THEN {_cmp('x_main', 'n_main', 'x_b', 'n_b', 'reactions')}
          WHEN cv = 1 THEN {_cmp('x_main', 'n_main', 'x_b', 'n_b', 'patients')}
          WHEN cv = 2 THEN CASE
              WHEN {_rate('n_main', 'n_c1')} > {_rate('r_all - n_main', 'n_all - n_c1')}
                THEN printf('Patients with %s (%s%% vs %s%%)', x_main, {_one(_rate('n_main', 'n_c1'))}, {_one(_rate('r_all - n_main', 'n_all - n_c1'))})
              WHEN {_rate('r_all - n_main', 'n_all - n_c1')} > {_rate('n_main', 'n_c1')}
                THEN printf('Patients without %s (%s%% vs %s%%)', x_main, {_one(_rate('r_all - n_main', 'n_all - n_c1'))}, {_one(_rate('n_main', 'n_c1'))})
              ELSE printf('Equal (%s%% each)', {_one(_rate('n_main', 'n_c1'))}) END
          ELSE CASE WHEN n_c1 > n_main - n_c1 THEN printf('Under %d (%d vs %d)', cut, n_c1, n_main - n_c1)
                    WHEN n_main - n_c1 > n_c1 THEN printf('%d and older (%d vs %d)', cut, n_main - n_c1, n_c1)
                    ELSE printf('Equal (%d each)', n_c1) END END
      WHEN 'Negative' THEN 'None'
      ELSE coalesce(notes[pick_rank], '') END AS answer,
    CASE qt WHEN 'Negative' THEN 0 WHEN 'EvidenceRetrieval' THEN 1
      WHEN 'Comparative' THEN CASE WHEN cv IN (0, 1) THEN n_main + n_b ELSE n_main END ELSE n_main END AS n_gt,
    CASE qt WHEN 'Negative' THEN '' WHEN 'EvidenceRetrieval' THEN members[pick_rank]
      WHEN 'Comparative' THEN CASE WHEN cv IN (0, 1) THEN concat_ws(', ', nullif(coalesce(ids_a, ''), ''), ids_b)
                                   ELSE coalesce(ids_a, '') END
      ELSE coalesce(ids_a, '') END AS gt_ids,
    CASE qt
      WHEN 'Lookup' THEN coalesce(flk, '')
      WHEN 'FilteredLookup' THEN coalesce(frx, '')
      WHEN 'MultiHop' THEN coalesce(frx, '')
      WHEN 'Aggregation' THEN '_aggregate => ' || CASE
          WHEN av = 0 THEN printf('%s exposed: %d, reactors: %d, severe: %d', x_main, n_c1, n_main, n_c2)
          WHEN av = 1 THEN printf('%s prescriptions: %d', x_main, n_main)
          WHEN av = 2 THEN printf('%s cohort size: %d', x_main, n_main)
          WHEN av = 3 THEN printf('%s patients with a severe reaction: %d', x_main, n_main)
          ELSE printf('%s patients: %d', x_main, n_main) END
      WHEN 'Comparative' THEN '_comparative => ' || CASE
          WHEN cv = 0 THEN printf('%s reactions: %d', x_main, n_main) || ' ; _comparative => ' || printf('%s reactions: %d', x_b, n_b)
          WHEN cv = 1 THEN printf('%s patients: %d', x_main, n_main) || ' ; _comparative => ' || printf('%s patients: %d', x_b, n_b)
          WHEN cv = 2 THEN printf('%s cohort: %d patients, %s%% reaction rate', x_main, n_c1, {_one(_rate('n_main', 'n_c1'))})
              || ' ; _comparative => ' || printf('non-%s cohort: %d patients, %s%% reaction rate', x_main, n_all - n_c1,
                                                  {_one(_rate('r_all - n_main', 'n_all - n_c1'))})
          ELSE printf('%s reactors under %d: %d', x_main, cut, n_c1) || ' ; _comparative => ' ||
               printf('%s reactors %d and older: %d', x_main, cut, n_main - n_c1) END
      WHEN 'Negative' THEN ''
      ELSE members[pick_rank] || ' => ' || x_main END AS facts,
    CASE
      WHEN qt = 'Aggregation' THEN array_to_string(f_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], ',')
      WHEN qt = 'Comparative' AND cv IN (0, 1) THEN array_to_string(list_concat(f_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], f_b[1:{K.AGGREGATE_CONTEXT_LIMIT}])[1:{K.AGGREGATE_CONTEXT_LIMIT}], ',')
      WHEN qt = 'Comparative' THEN array_to_string(f_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], ',')
      WHEN qt = 'Negative' THEN ''
      WHEN qt = 'EvidenceRetrieval' THEN 'chunk_' || members[pick_rank] || '_note_0'
      ELSE coalesce(chunks_a, '') END AS ctx,
    CASE
      WHEN qt = 'Aggregation' THEN array_to_string(t_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], chr(10) || chr(10))
      WHEN qt = 'Comparative' AND cv IN (0, 1) THEN array_to_string(list_concat(t_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], t_b[1:{K.AGGREGATE_CONTEXT_LIMIT}])[1:{K.AGGREGATE_CONTEXT_LIMIT}], chr(10) || chr(10))
      WHEN qt = 'Comparative' THEN array_to_string(t_a[1:{K.AGGREGATE_CONTEXT_LIMIT}], chr(10) || chr(10))
      WHEN qt = 'Negative' THEN ''
      WHEN qt = 'EvidenceRetrieval' THEN notes[pick_rank]
      ELSE coalesce(texts_a, '') END AS ctx_text
  FROM fmt)
SELECT printf('E%09d', eval_idx) AS eval_id, eval_idx, qt AS query_type, {diff} AS difficulty, query, answer,
  n_gt::BIGINT AS n_ground_truth, gt_ids AS ground_truth_ids, facts, ctx_text AS contexts, 42::BIGINT AS seed,
  (eval_idx // 1000)::BIGINT AS batch_id, ctx AS context_chunk_ids,
  (CASE WHEN ctx = '' THEN 0 ELSE len(string_split(ctx, ',')) END)::BIGINT AS n_contexts
FROM fin"""


EVAL_SET = eval_set_sql()


def _ground_truth_sql() -> str:
    """Every distinct predicate of a chosen attempt (or second side) against every patient."""
    fields = ["kind", "value", "min_age", "max_age", "gender", "region", "cond2", "cond3", "severe", "rtype", "reacted"]
    quoted = {"kind", "value", "gender", "region", "cond2", "cond3", "rtype"}
    key = " || ".join(f"""coalesce(',"{f}":' || """ + (f"""'"' || {f} || '"'""" if f in quoted else f"CAST({f} AS VARCHAR)") + ", '')" for f in fields)
    before = EVAL_SET[:EVAL_SET.index("ev AS (SELECT c.eval_idx")]
    return f"""{before}
used AS (SELECT DISTINCT {', '.join('sp.' + f for f in fields)} FROM chosen c JOIN spec sp ON sp.eval_idx = c.eval_idx
    AND ((sp.role = 'main' AND sp.attempt = c.att) OR sp.role = 'b')
  WHERE c.qt NOT IN ('Negative', 'EvidenceRetrieval')),
keyed AS (SELECT *, '{{' || substr({key}, 2) || '}}' AS predicate FROM used)
SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY p.patient_key)::BIGINT AS rank, p.patient_id,
  'reaction ' || coalesce(p.reaction_type, 'unknown') AS fact, 0 AS chunk_pos, p.chunk AS chunk_id
FROM keyed sp JOIN pat p ON {MATCH}"""


def _records_sql() -> str:
    lists = {"ground_truth_patient_ids": "string_split(ground_truth_ids, ', ')", "ground_truth_facts": "string_split(replace(facts, ' => ', '|'), ' ; ')",
             "contexts": "string_split(contexts, chr(10) || chr(10))", "context_chunk_ids": "string_split(context_chunk_ids, ',')"}
    source = {"ground_truth_patient_ids": "ground_truth_ids", "ground_truth_facts": "facts"}
    one = ["query", "answer", "query_type", "difficulty", "seed", "batch_id"]
    parts = [f"SELECT eval_id, {s(f)} AS field, [CAST({f} AS VARCHAR)] AS v FROM e" for f in one]
    parts += [f"SELECT eval_id, {s(f)}, {x} FROM e WHERE {source.get(f, f)} <> ''" for f, x in lists.items()]
    parts += [f"SELECT '', 'ragas', list_concat([query, answer, answer], CASE WHEN contexts = '' THEN [] ELSE {lists['contexts']} END) FROM e"]
    return (f"WITH e AS (SELECT * FROM ({EVAL_SET}) x), parts AS ({' UNION ALL '.join(parts)}) "
            "SELECT eval_id, field, (i - 1)::INTEGER AS pos, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM parts)")


SQL = {
    "eval_ground_truth": _ground_truth_sql(),
    "eval_records": _records_sql(),
    "eval_set": EVAL_SET,
    "ragas_set": f"SELECT query AS question, answer, contexts, answer AS ground_truth FROM ({EVAL_SET}) e",
    "eval_class_mix": f"SELECT query_type, difficulty, count(*)::BIGINT AS n_evals FROM ({EVAL_SET}) e GROUP BY ALL",
}
for _c, _ in K.QUERY_CLASS_WEIGHTS:
    SQL[f"eval_{_c.lower()}"] = f"SELECT * FROM ({EVAL_SET}) e WHERE query_type = {s(_c)}"
