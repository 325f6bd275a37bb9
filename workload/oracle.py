"""SQL twin of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SENTENCE_END = r"""([.!?]["'')\]]*)""" + WS + r"""+(["''(]?[A-Z0-9À-Ý])"""

ORACLE: dict[str, str] = {}


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def drop_words(x: str, offset: str, every: int) -> str:
    kept = f"list_filter({words(x)}, lambda w, i: (i - 1 + {offset}) % {every} <> 0)"
    return f"array_to_string({kept}, ' ')"


def cut(x: str) -> str:
    return strip(f"split_part({x}, chr(10), 1)")


def tok13a(x: str) -> str:
    t = f"regexp_replace({x}, '{WS}+$', '')"
    t = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"' ' || {t} || ' '"
    for pattern, repl in (
        (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{repl}', 'g')"
    return words(t)


def peeled(x: str) -> str:
    punct = r"[!-/:-@\[-`{-~]"
    return (
        f"flatten(list_transform({words(x)}, lambda w: CASE "
        f"WHEN length(w) > 1 AND regexp_matches(w, '{punct}$') "
        f"THEN [left(w, length(w) - 1), right(w, 1)] "
        f"WHEN length(w) > 1 AND regexp_matches(w, '^{punct}') "
        f"THEN [left(w, 1), substring(w, 2)] ELSE [w] END))"
    )


def sentence_ctes(text: str = "text", keep: str = "n_words BETWEEN 5 AND 89", parts: str = "s") -> str:
    return f"""
    split AS (
      SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS s
      FROM (SELECT doc_id, string_split(regexp_replace({text}, '{SENTENCE_END}',
            '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents)),
    stripped AS (SELECT doc_id, pos, {strip(parts)} AS sentence FROM split),
    counted AS (SELECT *, {n_words('sentence')} AS n_words FROM stripped),
    sentences AS (
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, doc_id || ':' || pos AS sent_id, sentence,
             CAST(n_words AS INTEGER) AS n_words
      FROM counted WHERE {keep})"""


SENTENCES = sentence_ctes()
FORWARD = (
    SENTENCES
    + f""",
    fwd AS (SELECT doc_id, pos, sent_id, sentence, CAST(k AS INTEGER) AS fwd_idx,
              {drop_words('sentence', 'k', 5)} AS fwd_text
            FROM sentences, range(3) AS r(k))"""
)
ROLLOUTS = (
    FORWARD
    + f""",
    rollouts AS (SELECT doc_id, pos, sent_id, sentence, fwd_idx, fwd_text,
              CAST(j AS INTEGER) AS bwd_idx,
              {drop_words('fwd_text', '2 * j + fwd_idx', 7)} AS bwd_text
            FROM fwd, range(2) AS r(j))"""
)
LANG = "lang(code, name) AS (VALUES ('en','English'),('fr','French'),('es','Spanish'),('de','German'))"
# The no-break space goes in and is taken out again.
_NBSP_OUT = "replace(replace({}, 'la ', 'la' || chr(160)), chr(160), ' ')"
PAIRS = f"""
    files AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'devtest' END AS split,
                text FROM documents),
    pairs AS (SELECT t.lang, t.id, t.split, {_NBSP_OUT.format('t.text')} AS text_tgt,
                {_NBSP_OUT.format(drop_words('e.text', '0', 4))} AS text_eng
              FROM files t JOIN files e ON t.id = e.id AND t.split = e.split WHERE t.lang <> 'en')"""
PREDICTIONS = (
    PAIRS
    + f""",
    predictions AS (SELECT lang, id, split, text_eng AS eng, text_tgt AS tgt,
        {drop_words('text_tgt', '1', 5)} AS fwd_pred, {drop_words('text_eng', '2', 7)} AS bwd_pred
      FROM pairs),
    frames AS (
      SELECT lang, id, split, 'forward' AS direction, eng AS source, tgt AS target_gold,
             fwd_pred AS target_pred FROM predictions
      UNION ALL
      SELECT lang, id, split, 'backward', tgt, eng, bwd_pred FROM predictions)"""
)


def chars(x: str) -> str:
    return f"regexp_extract_all({squeeze(x)}, '(?s).')"


def char_stats(pairs: str, keys: str, orders: int = 6, name: str = "char_stats", long: bool = False) -> str:
    """(keys, n, h, r, m) per pair; orders without n-grams on a side are missing.

    ``long`` texts are cut into characters once, since substring walks from the start."""
    if long:
        return token_stats(pairs, keys, chars, orders, name, sep="")
    return f"""
    {name}_text AS (SELECT {keys}, 1 AS is_hyp, {squeeze('hyp')} AS t FROM {pairs}
      UNION ALL SELECT {keys}, 0, {squeeze('ref')} FROM {pairs}),
    {name}_win AS (SELECT {keys}, is_hyp, substring(t, i, {orders}) AS w
      FROM {name}_text, range(1, length(t) + 1) AS p(i)),
    {name}_gram AS (SELECT {keys}, n, left(w, n) AS g,
        count(*) FILTER (is_hyp = 1) AS h, count(*) FILTER (is_hyp = 0) AS r
      FROM {name}_win, range(1, {orders + 1}) AS o(n) WHERE length(w) >= n GROUP BY ALL),
    {name} AS (SELECT {keys}, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m
      FROM {name}_gram GROUP BY ALL)"""


def token_stats(pairs: str, keys: str, tokens, orders: int, name: str, sep: str = " ") -> str:
    later = "".join(f", lead(t, {k}) OVER at_{name} AS t{k}" for k in range(1, orders))
    gram = " ".join(
        f"WHEN {n} THEN " + f" || '{sep}' || ".join(["t"] + [f"t{k}" for k in range(1, n)])
        for n in range(1, orders + 1)
    )
    return f"""
    {name}_text AS (SELECT {keys}, 1 AS is_hyp, {tokens('hyp')} AS ts FROM {pairs}
      UNION ALL SELECT {keys}, 0, {tokens('ref')} FROM {pairs}),
    {name}_tok AS (SELECT {keys}, is_hyp, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM {name}_text),
    {name}_win AS (SELECT *{later} FROM {name}_tok
      WINDOW at_{name} AS (PARTITION BY {keys}, is_hyp ORDER BY i)),
    {name}_all AS (SELECT {keys}, is_hyp, n, CASE n {gram} END AS g FROM {name}_win, range(1, {orders + 1}) AS o(n)),
    {name}_gram AS (SELECT {keys}, n, g,
        count(*) FILTER (is_hyp = 1) AS h, count(*) FILTER (is_hyp = 0) AS r
      FROM {name}_all WHERE g IS NOT NULL GROUP BY ALL),
    {name} AS (SELECT {keys}, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m
      FROM {name}_gram GROUP BY ALL)"""


def bleu(stats: str, keys: str, name: str, corpus: bool = False) -> str:
    """Score per key from (keys, n, h, r, m)."""
    usable = "sum(m) > 0" + (" AND count(*) FILTER (h > 0) = 4" if corpus else "")
    return f"""
    {name}_walk AS (SELECT *, sum(CASE WHEN h > 0 AND m = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY {keys} ORDER BY n) AS missed FROM {stats}),
    {name} AS (SELECT {keys}, CASE WHEN {usable} THEN
        exp(avg(ln(CASE WHEN m = 0 THEN 100.0 / pow(2.0, missed) / h ELSE 100.0 * m / h END)) FILTER (h > 0))
        * CASE WHEN sum(h) FILTER (n = 1) >= sum(r) FILTER (n = 1) THEN 1.0
               ELSE exp(1 - CAST(sum(r) FILTER (n = 1) AS DOUBLE) / sum(h) FILTER (n = 1)) END
        ELSE 0.0 END AS bleu
      FROM {name}_walk GROUP BY {keys})"""


def chrf(stats: str, keys: str, name: str, column: str = "chrf") -> str:
    return f"""
    {name}_pr AS (SELECT {keys},
        coalesce(avg(m / h) FILTER (h > 0 AND r > 0), 0) AS p,
        coalesce(avg(m / r) FILTER (h > 0 AND r > 0), 0) AS q
      FROM (SELECT {keys}, n, CAST(h AS DOUBLE) AS h, CAST(r AS DOUBLE) AS r, CAST(m AS DOUBLE) AS m
            FROM {stats}) GROUP BY {keys}),
    {name} AS (SELECT {keys}, CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0.0 END AS {column}
      FROM {name}_pr)"""


def all_scores(pairs: str, keys: str, prefix: str = "", long: bool = False) -> str:
    """CTEs {prefix}bleu, {prefix}chrf, {prefix}chrfpp per key. Keys absent from them score 0."""
    c, w, k = f"{prefix}cs", f"{prefix}ws", f"{prefix}ps"
    return ",".join(
        [
            char_stats(pairs, keys, 6, c, long),
            token_stats(pairs, keys, tok13a, 4, w),
            token_stats(pairs, keys, peeled, 2, k),
            f"""
    {c}p AS (SELECT * FROM {c} UNION ALL SELECT {keys}, n + 6, h, r, m FROM {k})""",
            bleu(w, keys, f"{prefix}bleu"),
            chrf(c, keys, f"{prefix}chrf"),
            chrf(f"{c}p", keys, f"{prefix}chrfpp", "chrfpp"),
        ]
    )


def select_scores(pairs: str, keys: str, columns: dict[str, str], exact: bool = False) -> str:
    """Scores of all keys of ``pairs``; ``columns`` maps output name -> score CTE."""
    joins = " ".join(f"LEFT JOIN {s} USING ({keys})" for s in dict.fromkeys(columns.values()))
    value = "coalesce({0}.{0}, 0)" if exact else "round(coalesce({0}.{0}, 0), 6)"
    cols = ", ".join(f"{value.format(s)} AS {c}" for c, s in columns.items())
    return f"SELECT {keys}, {cols} FROM {pairs} {joins}"


# --- sources, sentences ---

ORACLE["lang_dim"] = f"""WITH {LANG}
SELECT code, name, count(*) AS n_docs FROM documents JOIN lang ON lang = code GROUP BY ALL"""
ORACLE["unknown_langs"] = "SELECT DISTINCT lang AS code FROM documents WHERE lang NOT IN ('en', 'fr')"
ORACLE["corpus_scan"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents"
ORACLE["sentences"] = f"WITH {SENTENCES} SELECT * FROM sentences"
ORACLE["sentences_abbreviations"] = (
    "WITH "
    + sentence_ctes(
        text=f"regexp_replace(text, '(^|[^A-Za-z])(Mr|Mrs|Dr|etc|en|la|de)\\.({WS})', "
        "'\\1\\2' || chr(2) || '\\3', 'g')",
        parts="replace(s, chr(2), '.')",
    )
    + " SELECT * FROM sentences"
)
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OPENING = r"""^["''(\[]*"""
_TYPE = _OPENING + rf"""([{_LETTER}](?:[{_LETTER}.]*[{_LETTER}])?)(\.?)[!?"'')\],;:]*$"""


def _likelihood(hits: str, trials: str, chance: str) -> str:
    won = f"CASE WHEN {hits} > 0 THEN {hits} * ln({chance}) ELSE 0 END"
    return f"({won} + CASE WHEN {trials} > {hits} THEN ({trials} - {hits}) * ln(1 - {chance}) ELSE 0 END)"


_APART = f"{_likelihood('k', 'b', '(k / b)')} + {_likelihood('(n - k)', '(n_all - b)', '((n - k) / (n_all - b))')}"
_TOGETHER = f"{_likelihood('k', 'b', '(n / n_all)')} + {_likelihood('(n - k)', '(n_all - b)', '(n / n_all)')}"
ABBREVIATIONS = rf"""
    listed AS (SELECT doc_id, {words('text')} AS ws FROM documents),
    placed AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM listed),
    followed AS (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM placed),
    seen AS (
      SELECT nullif(regexp_extract(word, '{_TYPE}', 1), '') AS form,
             regexp_extract(word, '{_TYPE}', 2) = '.' AS dotted,
             regexp_matches(word, '[.!?]["'')\]]*$') AS marked, next,
             lower(regexp_extract(coalesce(next, ''), '{_TYPE}', 1)) AS after FROM followed),
    kinds AS (
      SELECT lower(form) AS type, form, dotted, after,
             CASE WHEN NOT marked THEN NULL WHEN next IS NULL THEN 'none' WHEN after = '' THEN 'other'
               WHEN regexp_matches(next, '{_OPENING}[a-zß-öø-ÿ]') THEN 'lower' ELSE 'upper' END AS kind FROM seen),
    types AS (
      SELECT type, count(*) FILTER (dotted) AS n_dot, count(*) FILTER (NOT dotted) AS n_plain,
             count(*) FILTER (dotted AND kind = 'lower') AS n_lower, count(*) AS n,
             array_to_string(list_sort(list(DISTINCT form) FILTER (dotted)), ' ') AS forms
      FROM kinds WHERE type IS NOT NULL GROUP BY type),
    totals AS (SELECT sum(n) AS n_all, sum(n_dot) AS dots FROM types),
    scored AS (
      SELECT types.*, 2 * (n_dot * ln(0.99::DOUBLE / rate) + n_plain * ln(0.01::DOUBLE / (1 - rate))) * exp(-letters)
               * (length(type) - letters + 1) * pow(letters, -n_plain) AS score
      FROM (SELECT *, length(replace(type, '.', '')) AS letters FROM types WHERE n_dot > 0) AS types,
           (SELECT least(dots / n_all, 0.99999::DOUBLE) AS rate FROM totals)),
    begun AS (
      SELECT after AS type, count(*) AS k FROM kinds
      WHERE kind IN ('lower', 'upper') AND NOT (dotted AND coalesce(type IN (SELECT type FROM scored WHERE score >= 0.3), false))
      GROUP BY after),
    starts AS (
      SELECT type FROM (SELECT type, k, n, n_all, sum(k) OVER () AS b FROM begun JOIN types USING (type), totals)
      WHERE 2 * ({_APART} - ({_TOGETHER})) >= 30 AND k * n_all > n * b),
    ended AS (
      SELECT type, count(*) AS n_ends FROM kinds
      WHERE dotted AND (kind = 'none' OR kind = 'upper' AND after IN (FROM starts)) GROUP BY type),
    learnt AS (
      SELECT type, forms, n_dot, n_plain, n_lower, coalesce(n_ends, 0) AS n_ends, score,
             score >= 0.3 AND coalesce(n_ends, 0) < 0.5 * n_dot AS learned
      FROM scored LEFT JOIN ended USING (type))"""
ORACLE["abbreviation_scores"] = f"""WITH {ABBREVIATIONS}
SELECT type, forms, n_dot, n_plain, n_lower, n_ends,
  CASE WHEN abs(score) < 0.0000005 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score, learned FROM learnt"""
ORACLE["sentences_learned"] = (
    f"WITH {ABBREVIATIONS}, "
    "top AS (SELECT forms FROM learnt WHERE learned ORDER BY n_dot DESC, type LIMIT 1000), "
    "names AS (SELECT string_agg(replace(form, '.', '\\.'), '|') AS names FROM (SELECT unnest(string_split(forms, ' ')) AS form FROM top)), "
    + sentence_ctes(
        text=f"(SELECT CASE WHEN names IS NULL THEN text ELSE regexp_replace(text, '(^|[^A-Za-z])(' || names || ')\\.({WS})', "
        "'\\1\\2' || chr(2) || '\\3', 'g') END FROM names)",
        parts="replace(s, chr(2), '.')",
    )
    + " SELECT * FROM sentences"
)
ORACLE["sentences_token_limit"] = (
    "WITH "
    + sentence_ctes(keep=f"n_words >= 5 AND len({tok13a('sentence')}) < 40")
    + " SELECT * FROM sentences"
)
ORACLE["sentences_first_n"] = (
    f"WITH {SENTENCES} SELECT * FROM sentences ORDER BY doc_id, pos LIMIT 500"
)
ORACLE["parallel_pairs"] = f"WITH {PAIRS} SELECT lang, id, split, text_tgt, text_eng FROM pairs"
ORACLE["parallel_first_n"] = (
    f"WITH {PAIRS} SELECT lang, id, split, text_tgt, text_eng FROM pairs ORDER BY id, lang LIMIT 50"
)
ORACLE["parallel_counts"] = f"""WITH {PAIRS},
names(wanted, split, bitext_split) AS (VALUES ('dev', 'dev', 'valid'), ('test', 'devtest', 'test'))
SELECT lang, wanted, split, bitext_split, count(*) AS n_pairs FROM pairs JOIN names USING (split) GROUP BY ALL"""
ORACLE["bitext_pairs"] = f"WITH {PAIRS} SELECT lang, id, text_eng AS eng, text_tgt AS tgt FROM pairs"
ORACLE["bitext_train"] = (
    f"WITH {PAIRS} SELECT id, lang, text_eng AS eng FROM pairs ORDER BY id, lang LIMIT 100"
)

# --- prompts, chat rows, transcripts ---

NL = "chr(10)"
ONLY = "Output only the translated text and no other text."
ASKED = f"""{SENTENCES}, {LANG},
    asked AS (SELECT s.*, code AS lang, name FROM sentences s, lang WHERE code <> 'en')"""


def fwd_prompt(text: str, name: str, instruct: bool = False) -> str:
    if instruct:
        return (
            f"('Translate the following English sentence into ' || {name} || '. {ONLY}' || {NL} || {NL}"
            f" || 'English: ' || {text})"
        )
    return (
        f"('Translate the following English sentence into ' || {name} || '.' || {NL} || {NL}"
        f" || 'English: ' || {text} || {NL} || {name} || ':')"
    )


def bwd_prompt(text: str, name: str, instruct: bool = False) -> str:
    if instruct:
        return (
            f"('Translate the following ' || {name} || ' sentence into English. {ONLY}' || {NL} || {NL}"
            f" || {name} || ': ' || {text})"
        )
    return (
        f"('Translate the following ' || {name} || ' sentence into English.' || {NL} || {NL}"
        f" || {name} || ': ' || {text} || {NL} || 'English:')"
    )


ORACLE["prompts_plain"] = f"""WITH {ASKED}
SELECT sent_id, lang, CASE WHEN pos % 3 = 0 THEN sentence ELSE {fwd_prompt('sentence', 'name')} END AS fwd_prompt,
  CASE WHEN pos % 3 = 0 THEN sentence ELSE {bwd_prompt('sentence', 'name')} END AS bwd_prompt FROM asked"""
ORACLE["prompts_instruct"] = f"""WITH {ASKED}
SELECT sent_id, lang, {fwd_prompt('sentence', 'name', True)} AS fwd_prompt,
  {bwd_prompt('sentence', 'name', True)} AS bwd_prompt FROM asked"""
INFO = """'{"target_lang":"' || lang || '","lang_name":"' || name || '"}'"""
ORACLE["chat_rows_mono"] = f"""WITH {ASKED}
SELECT sent_id, 'user' AS role, {fwd_prompt('sentence', 'name', True)} AS content, sentence AS answer,
  {INFO} AS info FROM asked"""
ORACLE["chat_rows_parallel"] = f"""WITH {PAIRS}, {LANG}, named AS (SELECT * FROM pairs JOIN lang ON lang = code)
SELECT id, split, 'forward' AS direction, 'user' AS role, {fwd_prompt('text_eng', 'name', True)} AS content,
  text_tgt AS answer, {INFO} AS info FROM named
UNION ALL
SELECT id, split, 'backward', 'user', {bwd_prompt('text_tgt', 'name', True)}, text_eng, {INFO} FROM named"""
TRANSCRIPTS = f"""
    transcripts AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND conv_id % 2 = 0
        THEN '<think>step ' || turn || '</think> ' || text ELSE text END AS text FROM conversations),
    answers AS (SELECT conv_id, max(turn) AS last_turn,
        arg_max(text, turn) FILTER (role = 'assistant') AS raw FROM transcripts GROUP BY conv_id),
    finals AS (SELECT conv_id, last_turn, {strip("list_last(string_split(raw, '</think>'))")} AS answer FROM answers)"""
ORACLE["final_answers"] = f"WITH {TRANSCRIPTS} SELECT conv_id, answer FROM finals"
ORACLE["next_turn"] = f"""WITH {TRANSCRIPTS},
named AS (SELECT *, CASE WHEN conv_id % 3 <> 0 THEN 'German' ELSE 'the target language' END AS name FROM finals)
SELECT conv_id, turn, role, text FROM transcripts
UNION ALL
SELECT conv_id, last_turn + 1, 'user', {bwd_prompt('answer', 'name', True)} FROM named WHERE answer IS NOT NULL"""

# --- candidates ---

COMPLETIONS = f"""{FORWARD},
    completions AS (SELECT sent_id, sentence, fwd_idx, CASE WHEN (doc_id + pos + fwd_idx) % 50 = 0 THEN ''
        WHEN (doc_id + pos + fwd_idx) % 3 = 0 THEN ' ' || fwd_text || ' ' || chr(10) || 'and so on' || chr(10)
        ELSE fwd_text END AS text FROM fwd)"""
ORACLE["completions_clean"] = (
    f"WITH {COMPLETIONS} SELECT sent_id, fwd_idx, {cut('text')} AS completion FROM completions"
)
ORACLE["rollout_tree"] = (
    f"WITH {ROLLOUTS} SELECT sent_id, sentence, fwd_idx, fwd_text, bwd_idx, bwd_text FROM rollouts"
)
ORACLE["rollouts_nested"] = f"""WITH {ROLLOUTS},
inner_lists AS (SELECT sent_id, fwd_idx, any_value(fwd_text) AS fwd_text,
    string_agg(bwd_text, ' / ' ORDER BY bwd_idx) AS b FROM rollouts GROUP BY ALL)
SELECT sent_id, string_agg(fwd_text, ' | ' ORDER BY fwd_idx) AS fwd_texts,
  string_agg(b, ' | ' ORDER BY fwd_idx) AS bwd_texts FROM inner_lists GROUP BY sent_id"""
ORACLE["rollouts_flattened"] = f"WITH {FORWARD} SELECT sent_id, fwd_idx, fwd_text FROM fwd"
ORACLE["source_pairing"] = (
    f"WITH {ROLLOUTS} SELECT sent_id, fwd_idx, bwd_idx, bwd_text, sentence FROM rollouts"
)
ORACLE["direction_frames"] = (
    f"WITH {PREDICTIONS} SELECT lang, id, split, direction, source, target_gold, target_pred FROM frames"
)
ORACLE["preview"] = f"""WITH {PREDICTIONS}
SELECT lang, direction, CAST(rank AS INTEGER) AS rank, id, target_pred, target_gold FROM (SELECT *, row_number() OVER
  (PARTITION BY lang, direction ORDER BY id) AS rank FROM frames) WHERE rank <= 5"""

# --- text scores ---

FIRST = f"""{SENTENCES},
    cand AS (SELECT doc_id, pos, sentence AS ref, {drop_words('sentence', '1', 5)} AS hyp FROM sentences)"""
ORACLE["tok13a"] = f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {tok13a('text')} AS t FROM documents)"""


def _stats_query(ctes: str, name: str, orders: int) -> str:
    return f"""WITH {FIRST}, {ctes}
SELECT doc_id, pos, CAST(o.n AS INTEGER) AS n, CAST(coalesce(h, 0) AS BIGINT) AS hyp_ngrams,
  CAST(coalesce(r, 0) AS BIGINT) AS ref_ngrams, CAST(coalesce(m, 0) AS BIGINT) AS matches
FROM cand CROSS JOIN range(1, {orders + 1}) AS o(n) LEFT JOIN {name} s USING (doc_id, pos, n)"""


ORACLE["word_ngram_stats"] = _stats_query(token_stats("cand", "doc_id, pos", tok13a, 4, "ws"), "ws", 4)
ORACLE["char_ngram_stats"] = _stats_query(char_stats("cand", "doc_id, pos", 6, "cs"), "cs", 6)
for _name, _score in (("sentence_bleu", "bleu"), ("sentence_chrf", "chrf"), ("sentence_chrfpp", "chrfpp")):
    ORACLE[_name] = f"WITH {FIRST}, {all_scores('cand', 'doc_id, pos')} " + select_scores(
        "cand", "doc_id, pos", {"score": _score}
    )
ORACLE["sentence_metric_by_name"] = f"WITH {FIRST}, {all_scores('cand', 'doc_id, pos')} " + select_scores(
    "cand", "doc_id, pos", {"bleu": "bleu", "chrf": "chrf", "chrfpp": "chrfpp"}
)
ORACLE["sentence_scores_exploded"] = f"WITH {FIRST}, {all_scores('cand', 'doc_id, pos')} " + select_scores(
    "cand", "doc_id, pos", {"bleu": "bleu", "chrfpp": "chrfpp"}
)


def _corpus_sums(stats: str, by: str, name: str) -> str:
    return f"""
    {name} AS (SELECT {by}, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM {stats} GROUP BY ALL)"""


def _corpus_ctes(frames: str, keys: str, by: str) -> str:
    return ",".join(
        [
            f"""
    scored AS (SELECT {keys}, target_pred AS hyp, target_gold AS ref FROM {frames})""",
            char_stats("scored", keys, 6, "cs", long=True),
            token_stats("scored", keys, tok13a, 4, "ws"),
            token_stats("scored", keys, peeled, 2, "ps"),
            _corpus_sums("cs", by, "csum"),
            _corpus_sums("ws", by, "wsum"),
            f"""
    cpsum AS (SELECT * FROM csum UNION ALL SELECT {by}, n + 6, sum(h), sum(r), sum(m) FROM ps GROUP BY ALL)""",
            bleu("wsum", by, "bleu", corpus=True),
            chrf("csum", by, "chrf"),
            chrf("cpsum", by, "chrfpp", "chrfpp"),
        ]
    )


_CORPUS = f"WITH {PREDICTIONS}, {_corpus_ctes('frames', 'lang, split, direction, id', 'lang, split, direction')}"
ORACLE["corpus_bleu"] = f"""{_CORPUS}
SELECT lang, split, round(bleu, 6) AS bleu FROM bleu WHERE direction = 'forward'"""
ORACLE["corpus_chrf"] = f"""{_CORPUS}
SELECT lang, split, round(chrf, 6) AS chrf, round(chrfpp, 6) AS chrfpp
FROM chrf JOIN chrfpp USING (lang, split, direction) WHERE direction = 'forward'"""
ORACLE["eval_report"] = f"""{_CORPUS}
SELECT lang, split, direction, 'bleu' AS metric, round(bleu, 6) AS score FROM bleu
UNION ALL SELECT lang, split, direction, 'chrf++', round(chrfpp, 6) FROM chrfpp WHERE direction = 'forward'
UNION ALL SELECT lang, split, direction, 'chrf', round(chrf, 6) FROM chrf WHERE direction = 'backward'"""
_RUBRIC_KEYS = "lang, direction, id, rollout"
ORACLE["rubric_scores"] = f"""WITH {PREDICTIONS},
rolled AS (SELECT lang, direction, id, j AS rollout, {drop_words('target_pred', 'j', 6)} AS hyp, target_gold AS ref
  FROM frames, range(2) AS r(j)), {all_scores('rolled', _RUBRIC_KEYS, long=True)},
scores AS ({select_scores('rolled', _RUBRIC_KEYS, {'bleu': 'bleu', 'chrf': 'chrf'}, exact=True)}),
examples AS (SELECT lang, direction, id, avg(chrf + 0.5 * bleu) AS reward FROM scores GROUP BY ALL)
SELECT lang, direction, count(*) AS n_examples, round(avg(reward), 6) AS reward FROM examples GROUP BY ALL"""

ORACLE["transcript_rewards"] = f"""WITH {TRANSCRIPTS},
firsts AS (SELECT conv_id, arg_min(text, turn) AS expected FROM transcripts GROUP BY conv_id),
replies AS (SELECT conv_id, answer AS hyp, expected AS ref FROM finals JOIN firsts USING (conv_id)
  WHERE answer IS NOT NULL), {all_scores('replies', 'conv_id', long=True)},
rated AS ({select_scores('replies', 'conv_id', {'reward': 'chrf'})})
SELECT conv_id, CASE WHEN answer IS NULL THEN 0.0 ELSE coalesce(reward, 0.0) END AS reward, answer IS NOT NULL AS answered
FROM finals LEFT JOIN rated USING (conv_id)"""

# --- rewards ---

_ROLLOUT_KEYS = "sent_id, fwd_idx, bwd_idx"
def _rewards(rollouts: str) -> str:
    """Scores of distinct (back-translation, sentence) texts by a whole number, then back to the rollouts."""
    return f"""
    texts AS (SELECT DISTINCT bwd_text AS hyp, sentence AS ref FROM {rollouts}),
    scored AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hyp, ref) AS pid, hyp, ref FROM texts),
    {all_scores('scored', 'pid')},
    rated AS (SELECT hyp, ref, coalesce(bleu, 0) AS bleu, coalesce(chrfpp, 0) AS chrf
      FROM scored LEFT JOIN bleu USING (pid) LEFT JOIN chrfpp USING (pid)),
    exact AS (SELECT {_ROLLOUT_KEYS}, bleu, chrf FROM {rollouts} JOIN rated ON hyp = bwd_text AND ref = sentence),
    rewards AS (SELECT {_ROLLOUT_KEYS}, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf FROM exact),
    fwd_rewards AS (SELECT sent_id, fwd_idx, round(avg(bleu), 6) AS bleu, round(avg(chrf), 6) AS chrf
      FROM exact GROUP BY ALL)"""


REWARDS = f"{ROLLOUTS}, {_rewards('rollouts')}"
ORACLE["cycle_rewards"] = f"WITH {REWARDS} SELECT * FROM rewards"
ORACLE["forward_rewards"] = f"WITH {REWARDS} SELECT * FROM fwd_rewards"
ORACLE["forward_rewards_sum"] = f"""WITH {REWARDS} SELECT sent_id, fwd_idx, round(sum(bleu), 6) AS bleu, round(sum(chrf), 6) AS chrf
FROM exact GROUP BY ALL"""


def advantage(value: str, group: str) -> str:
    return (
        f"CASE WHEN count(*) OVER {group} = 1 OR max({value}) OVER {group} = min({value}) OVER {group} THEN 0.0 "
        f"ELSE ({value} - avg({value}) OVER {group}) / greatest(stddev_samp({value}) OVER {group}, 1e-8) END"
    )


def _advantages(table: str, keys: str, group: str) -> str:
    g = f"(PARTITION BY {group})"
    return f"""SELECT {keys}, round(a, 6) AS adv_bleu, round(b, 6) AS adv_chrf, round((a + b) / 2, 6) AS advantage,
  group_size FROM (SELECT {keys}, {advantage('bleu', g)} AS a, {advantage('chrf', g)} AS b,
  count(*) OVER {g} AS group_size FROM {table})"""


ORACLE["advantages_bwd"] = f"WITH {REWARDS} " + _advantages("rewards", _ROLLOUT_KEYS, "sent_id, fwd_idx")
ORACLE["advantages_fwd"] = f"WITH {REWARDS} " + _advantages("fwd_rewards", "sent_id, fwd_idx", "sent_id")

# --- correlation ---

_CAND_KEYS = "lang, id, fwd_idx"
CANDIDATE_SCORES = f"""{PAIRS},
    candidates AS (SELECT lang, id, CAST(k AS INTEGER) AS fwd_idx, text_tgt AS gold, text_eng AS source,
        {drop_words('text_tgt', 'k', 5)} AS fwd_text, {drop_words('text_eng', '2 * k', 7)} AS bwd_text
      FROM pairs, range(3) AS r(k)),
    direct AS (SELECT {_CAND_KEYS}, fwd_text AS hyp, gold AS ref FROM candidates),
    there_back AS (SELECT {_CAND_KEYS}, bwd_text AS hyp, source AS ref FROM candidates),
    {all_scores('direct', _CAND_KEYS, 'd_', long=True)},
    {all_scores('there_back', _CAND_KEYS, 'b_', long=True)},
    cscores AS (SELECT {_CAND_KEYS}, round(coalesce(d_bleu.bleu, 0), 6) AS bleu,
        round(coalesce(b_bleu.bleu, 0), 6) AS roundtrip_bleu,
        round(coalesce(d_chrfpp.chrfpp, 0), 6) AS chrf, round(coalesce(b_chrfpp.chrfpp, 0), 6) AS roundtrip_chrf
      FROM candidates LEFT JOIN d_bleu USING ({_CAND_KEYS}) LEFT JOIN b_bleu USING ({_CAND_KEYS})
        LEFT JOIN d_chrfpp USING ({_CAND_KEYS}) LEFT JOIN b_chrfpp USING ({_CAND_KEYS}))"""


def zscore(value: str, group: str) -> str:
    return (
        f"CASE WHEN max({value}) OVER {group} > min({value}) OVER {group} "
        f"THEN ({value} - avg({value}) OVER {group}) / stddev_samp({value}) OVER {group} END AS {value}"
    )


_SCORES = ["bleu", "roundtrip_bleu", "chrf", "roundtrip_chrf"]
ZSCORES = f"""{CANDIDATE_SCORES},
    z AS (SELECT {_CAND_KEYS}, {', '.join(zscore(s, '(PARTITION BY lang, id)') for s in _SCORES)} FROM cscores),
    usable AS (SELECT 'bleu' AS metric, {_CAND_KEYS}, roundtrip_bleu AS x, bleu AS y, roundtrip_bleu AS z
      FROM z WHERE roundtrip_bleu IS NOT NULL AND bleu IS NOT NULL
      UNION ALL
      SELECT 'chrf', {_CAND_KEYS}, roundtrip_chrf, chrf, roundtrip_bleu FROM z WHERE roundtrip_bleu IS NOT NULL
        AND bleu IS NOT NULL AND roundtrip_chrf IS NOT NULL AND chrf IS NOT NULL)"""
ORACLE["candidate_scores"] = f"WITH {CANDIDATE_SCORES} SELECT * FROM cscores"
ORACLE["group_zscores"] = f"WITH {ZSCORES} SELECT {_CAND_KEYS}, " + ", ".join(
    f"round({s}, 6) AS {s}" for s in _SCORES
) + " FROM z"
ORACLE["sent_index"] = f"""WITH {FORWARD}
SELECT doc_id, pos, fwd_idx, dense_rank() OVER (ORDER BY doc_id, pos) - 1 AS sent_idx FROM fwd"""
ORACLE["block_index"] = f"""WITH {SENTENCES}
SELECT doc_id, pos, CAST((row_number() OVER (ORDER BY doc_id, pos) - 1) // 10 AS BIGINT) AS sent_idx FROM sentences"""
ORACLE["finite_rows"] = f"WITH {ZSCORES} SELECT metric, {_CAND_KEYS} FROM usable"
ORACLE["roundtrip_regression"] = f"""WITH {ZSCORES},
fit AS (SELECT metric, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r,
  regr_r2(y, x) AS r2, sqrt((1 - corr(y, x) * corr(y, x)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)) AS se
  FROM usable GROUP BY metric)
SELECT metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(r2, 6) AS r2,
  round(se, 6) AS stderr, round(slope / se, 6) AS t FROM fit"""
ORACLE["roundtrip_p_value"] = f"""WITH RECURSIVE {ZSCORES},
fit AS (SELECT metric, count(*) AS n, regr_slope(y, x) / sqrt((1 - corr(y, x) * corr(y, x)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2))
  AS t, (count(*) - 2) / 2 AS a FROM usable GROUP BY metric),
args AS MATERIALIZED (SELECT *, 2 * a / (2 * a + t * t) AS u, 2 * a / (2 * a + t * t) < (a + 1) / (a + 2.5) AS low FROM fit),
sides AS MATERIALIZED (SELECT *, CASE WHEN low THEN a ELSE 0.5 END AS p, CASE WHEN low THEN 0.5 ELSE a END AS q,
  CASE WHEN low THEN u ELSE 1 - u END AS v FROM args),
lentz AS (
  SELECT metric, p, q, v, 2 AS k, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * v / (p + 1)) AS d, 1 / (1 - (p + q) * v / (p + 1)) AS value FROM sides
  UNION ALL
  SELECT metric, p, q, v, k + 1, 1 + e / c, 1 / (1 + e * d), value * (1 + e / c) / (1 + e * d)
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN (k // 2) * (q - k // 2) * v / ((p + k - 1) * (p + k))
    ELSE -(p + k // 2) * (p + q + k // 2) * v / ((p + k - 1) * (p + k)) END AS e FROM lentz WHERE k < 300)),
ends AS (SELECT s.*, value, exp(lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + a * ln(u) + 0.5 * ln(1 - u)) AS front
  FROM lentz JOIN sides s USING (metric) WHERE k = 300)
SELECT metric, n, round(t, 6) AS t, round(CASE WHEN low THEN front * value / a ELSE 1 - front * value / 0.5 END, 9) AS p FROM ends"""
ORACLE["fit_line"] = f"""WITH {ZSCORES},
fit AS (SELECT metric, min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS s, regr_intercept(y, x) AS c
  FROM usable GROUP BY metric),
line AS (SELECT metric, CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 199 AS x, s, c FROM fit, range(200) AS g(i))
SELECT metric, i, round(x, 6) AS x, round(s * x + c, 6) AS y FROM line"""


def _profile(grid: str, name: str, key: str) -> str:
    return f"""
    {name}_sums AS (SELECT {key}, lam, sum(n - c * sz * sz) AS a11, sum(sx - c * sz * szx) AS a12,
        sum(sxx - c * szx * szx) AS a22, sum(sy - c * sz * szy) AS b1, sum(sxy - c * szx * szy) AS b2,
        sum(syy - c * szy * szy) AS q, sum(n) AS n_rows, count(*) AS n_groups, sum(ln(1 + lam * szz)) AS logdet
      FROM (SELECT *, lam / (1 + lam * szz) AS c FROM groups JOIN {grid} USING ({key})) GROUP BY ALL),
    {name}_fit AS (SELECT *, a11 * a22 - a12 * a12 AS det, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS intercept,
        (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS slope FROM {name}_sums),
    {name}_var AS (SELECT *, (q - intercept * b1 - slope * b2) / (n_rows - 2) AS sigma2 FROM {name}_fit),
    {name} AS MATERIALIZED (SELECT * FROM (SELECT *, lag(lam) OVER o AS low, lead(lam) OVER o AS high,
        row_number() OVER (PARTITION BY {key} ORDER BY (n_rows - 2) * ln(sigma2) + logdet + ln(det), lam) AS k
      FROM {name}_var WINDOW o AS (PARTITION BY {key} ORDER BY lam)) WHERE k = 1)"""


def _reml(key: str) -> str:
    """Twelfths of a decade up to 10^12, then four ever finer grids around the best: no derivative, no ratio left out."""
    steps = [f"""
    grid_0 AS (SELECT {key}, CASE WHEN i = 0 THEN 0.0 ELSE 10.0 ** ((i - 145) / 12.0) END AS lam
      FROM (SELECT DISTINCT {key} FROM groups), range(290) AS r(i))"""]
    for level in range(5):
        if level:
            steps.append(f"""
    grid_{level} AS (SELECT {key}, coalesce(low, lam) + i * (coalesce(high, lam) - coalesce(low, lam)) / 60 AS lam
      FROM level_{level - 1}, range(61) AS r(i))""")
        steps.append(_profile(f"grid_{level}", f"level_{level}", key))
    return ",".join(steps)


_SUMS = """CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS sxx, sum(x * y) AS sxy,
  sum(y * y) AS syy, sum(z * z) AS szz, sum(z * x) AS szx, sum(z * y) AS szy"""
ORACLE["mixed_slope"] = f"""WITH {ZSCORES},
groups AS (SELECT metric, lang, id, {_SUMS} FROM usable GROUP BY ALL), {_reml('metric')}
SELECT metric, CAST(n_rows AS BIGINT) AS n_rows, n_groups, round(intercept, 5) AS intercept, round(slope, 5) AS slope,
  round(sqrt(sigma2 * a22 / det), 5) AS intercept_se, round(sqrt(sigma2 * a11 / det), 5) AS slope_se,
  round(sigma2, 5) AS sigma2, round(lam * sigma2, 3) AS slope_variance, round(lam, 3) AS lam FROM level_4"""
ORACLE["mixed_summary"] = f"""WITH {ZSCORES},
groups AS (SELECT metric, lang, id, {_SUMS} FROM usable GROUP BY ALL), {_reml('metric')},
rows AS (SELECT metric, CAST(n_rows AS BIGINT) AS n_rows, n_groups, unnest(['intercept', 'slope']) AS coefficient,
  unnest([intercept, slope]) AS estimate, unnest([sqrt(sigma2 * a22 / det), sqrt(sigma2 * a11 / det)]) AS se,
  -((n_rows - 2) * ln(sigma2) + logdet + ln(det) + (n_rows - 2) * (1 + ln(2 * pi()))) / 2 AS log_likelihood FROM level_4),
middle AS (SELECT metric, coefficient, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-0.5 * (estimate / se * i / 4000) ** 2)) * abs(estimate / se) / 4000 / 3 / sqrt(2 * pi()) AS half
  FROM rows, range(4001) AS r(i) GROUP BY metric, coefficient, estimate, se)
SELECT metric, coefficient, round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate / se, 3) AS z,
  round(estimate - 1.959963984540054 * se, 3) AS low, round(estimate + 1.959963984540054 * se, 3) AS high, round(1 - 2 * half, 3) AS p,
  round(log_likelihood, 3) AS log_likelihood, n_rows, n_groups FROM rows JOIN middle USING (metric, coefficient)"""
ORACLE["predicted_slopes"] = f"""WITH {ZSCORES},
groups AS (SELECT metric, lang, id, {_SUMS} FROM usable GROUP BY ALL), {_reml('metric')}
SELECT metric, lang || ':' || id AS sent_idx, CAST(n AS BIGINT) AS n,
  round(lam * (szy - intercept * sz - slope * szx) / (1 + lam * szz), 3) AS predicted, round(lam * szz / (1 + lam * szz), 3) AS kept_share
FROM groups JOIN level_4 USING (metric)"""
ORACLE["mixed_slope_strong"] = f"""WITH {ZSCORES},
steep AS (SELECT lang, id, roundtrip_bleu AS x, roundtrip_chrf AS z,
    0.5 * roundtrip_bleu + 0.1 * bleu + (id * 37 % 41 - 20) * roundtrip_chrf AS y
  FROM z WHERE roundtrip_bleu IS NOT NULL AND bleu IS NOT NULL AND roundtrip_chrf IS NOT NULL),
groups AS (SELECT lang, id, {_SUMS} FROM steep GROUP BY ALL), {_reml('lang')}
SELECT lang, CAST(n_rows AS BIGINT) AS n_rows, n_groups, round(intercept, 4) AS intercept, round(slope, 4) AS slope,
  round(sigma2, 4) AS sigma2, lam > 127 AS above FROM level_4"""

# --- logged log-probabilities ---

ORACLE["completion_mask"] = f"""WITH {COMPLETIONS},
lens AS (SELECT sent_id, fwd_idx, {n_words('sentence')} AS p, {n_words('text')} AS c FROM completions)
SELECT sent_id, fwd_idx, repeat('0', p) || repeat('1', c) AS mask,
  array_to_string(list_transform(range(p + c + 1), lambda i: CASE WHEN i % (c + 1) <> 0 THEN '1' ELSE '0' END), '')
    AS label_mask FROM lens"""
ORACLE["empty_completions"] = f"""WITH {COMPLETIONS},
lens AS (SELECT sent_id, fwd_idx, CAST({n_words(cut('text'))} AS INTEGER) AS completion_len FROM completions)
SELECT *, CASE WHEN completion_len = 0 THEN 'no_tokens' ELSE 'mask_all_zero' END AS reason
FROM lens WHERE completion_len <= 2"""
ORACLE["sequence_text"] = f"""WITH {FORWARD}
SELECT sent_id, fwd_idx, {fwd_prompt('sentence', "'French'")} || ' ' || fwd_text AS sequence FROM fwd"""
TERMS = f"""{FORWARD},
    logs AS (SELECT sent_id, fwd_idx, (length(fwd_text) % 17) / 10.0::DOUBLE AS bleu,
        (length(fwd_text) % 13) / 10.0::DOUBLE AS chrf, {words('fwd_text')} AS w FROM fwd),
    adv AS (SELECT sent_id, fwd_idx, bleu, chrf, w, ({advantage('bleu', '(PARTITION BY sent_id)')}
        + {advantage('chrf', '(PARTITION BY sent_id)')}) / 2 AS advantage FROM logs),
    tokens AS (SELECT sent_id, fwd_idx, advantage, i, i >= 2 AS on_, ((i % 5) - 2) / 20.0::DOUBLE AS d,
        -((i % 4) / 40.0::DOUBLE) - ((i % 5) - 2) / 20.0::DOUBLE AS e
      FROM adv, range(len(w)) AS r(i)),
    token_terms AS (SELECT *, exp(e) - e - 1 AS kl,
        least(exp(d) * advantage, least(greatest(exp(d), 0.8), 1.2) * advantage) AS objective FROM tokens),
    means AS (SELECT sent_id, fwd_idx, avg(0.1 * kl - objective) FILTER (on_) AS loss, avg(kl) FILTER (on_) AS kl
      FROM token_terms GROUP BY ALL),
    terms AS (SELECT sent_id, fwd_idx, bleu, chrf, advantage, loss, kl FROM adv LEFT JOIN means USING (sent_id, fwd_idx))"""
ORACLE["grpo_terms"] = f"""WITH {TERMS}
SELECT sent_id, fwd_idx, round(advantage, 6) AS advantage, round(loss, 6) AS loss, round(kl, 6) AS kl FROM terms"""
ORACLE["grpo_loss"] = f"""WITH {TERMS},
losses AS (SELECT CASE WHEN fwd_idx = 0 THEN 'forward' ELSE 'backward' END AS direction, avg(loss) AS loss,
  avg(kl) AS kl, count(loss) AS n_sequences, count(*) - count(loss) AS n_empty FROM terms GROUP BY ALL)
SELECT direction, round(loss, 6) AS loss, round(kl, 6) AS kl, n_sequences, n_empty FROM losses
UNION ALL SELECT 'mixed', round(sum(loss * CASE direction WHEN 'forward' THEN 0.25 ELSE 0.75 END), 6), NULL, NULL, NULL
FROM losses"""
PLACED = f"""
    placed AS (SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('0:' || epoch || ':' || sent_id), sent_id)
        - 1 AS position, sent_id FROM (SELECT sent_id, CAST(e AS INTEGER) AS epoch FROM sentences, range(2) AS r(e))),
    batched AS (SELECT epoch, position, position // 16 AS batch, sent_id FROM placed)"""
ORACLE["epoch_batches"] = f"WITH {SENTENCES}, {PLACED} SELECT * FROM batched"
ORACLE["shards"] = f"""WITH {SENTENCES}, {PLACED},
sizes AS (SELECT epoch, count(*) AS n FROM placed GROUP BY epoch),
padded AS (SELECT epoch, position, sent_id, false AS is_pad FROM placed
  UNION ALL SELECT epoch, n + position, sent_id, true FROM placed JOIN sizes USING (epoch)
    WHERE position < (7 - n % 7) % 7)
SELECT epoch, position, sent_id, is_pad, position % 7 AS shard FROM padded"""
ORACLE["eval_shards"] = f"""WITH {SENTENCES},
placed AS (SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS position FROM sentences)
SELECT *, position % 7 AS shard FROM placed"""
STEPS = f"""{TERMS}, {PLACED},
    per_batch AS (SELECT epoch, batch, avg(loss) AS loss, avg(kl) AS kl, avg(bleu) AS bleu, avg(chrf) AS chrf
      FROM batched JOIN terms USING (sent_id) GROUP BY ALL),
    running AS (SELECT *, epoch * (max(batch) OVER () + 1) + batch AS nth FROM per_batch),
    steps AS (SELECT nth // 4 AS step, max(epoch) AS epoch, sum(loss) * 0.25 / 4 AS fwd_loss,
        sum(loss / 2) * 0.75 / 4 AS bwd_loss, sum(kl) / 4 AS fwd_kl, sum(kl / 2) / 4 AS bwd_kl,
        sum(bleu) / 4 AS reward_bleu, sum(chrf) / 4 AS reward_chrf FROM running GROUP BY nth // 4 HAVING count(*) = 4)"""
ORACLE["step_log"] = f"""WITH {STEPS} SELECT step, epoch, {', '.join(f'round({c}, 9) AS {c}' for c in
  ['fwd_loss', 'bwd_loss', 'fwd_kl', 'bwd_kl', 'reward_bleu', 'reward_chrf'])} FROM steps"""
ORACLE["epoch_log"] = f"""WITH {STEPS}
SELECT epoch, count(*) AS n_steps, round(sum(reward_bleu), 9) AS reward_bleu, round(sum(reward_chrf), 9) AS reward_chrf
FROM steps GROUP BY epoch"""
ORACLE["example_table"] = f"""WITH {ROLLOUTS},
shown AS (SELECT sent_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS example_idx FROM sentences
  ORDER BY doc_id, pos LIMIT 5),
few AS (SELECT rollouts.* FROM rollouts JOIN shown USING (sent_id)), {_rewards('few')}
SELECT sentence AS original_english, CAST(example_idx AS INTEGER) AS fwd_idx, fwd_text AS predicted_target, r.fwd_idx AS bwd_idx,
  bwd_text AS final_predicted_english, round(f.bleu, 6) AS bleu, round(f.chrf, 6) AS chrf
FROM few r JOIN shown USING (sent_id) JOIN fwd_rewards f ON f.sent_id = r.sent_id AND f.fwd_idx = r.fwd_idx
WHERE bwd_idx = 0"""

# --- files, logs, streams and sampled rollouts ---

ORACLE["lang_csv"] = ORACLE["lang_dim"]
ORACLE["parallel_folder"] = f"WITH {PAIRS} SELECT lang, id, split, text_tgt, text_eng FROM pairs WHERE split = 'dev'"
ORACLE["correlation_csv"] = f"""WITH {ZSCORES},
numbered AS (SELECT *, row_number() OVER (ORDER BY {_CAND_KEYS}) - 1 AS row_index FROM z)
SELECT row_index, {", ".join(f"round({s}, 6) AS {s}" for s in _SCORES)}, row_index // 10 AS sent_idx FROM numbered"""
ORACLE["metric_log"] = f"""SELECT step, split, lang, direction, metric, score
FROM ({ORACLE["eval_report"]}) AS report, (VALUES (1::BIGINT), (2)) AS s(step)"""
ORACLE["streamed_sentences"] = ORACLE["sentences"]
ORACLE["streamed_rewards"] = ORACLE["cycle_rewards"]
ORACLE["streamed_first_n"] = ORACLE["sentences_first_n"]
ORACLE["streamed_advantages"] = f"""WITH {REWARDS},
means AS (SELECT sent_id, fwd_idx, CAST(NULL AS INTEGER) AS bwd_idx, round(avg(bleu), 9) AS bleu, round(avg(chrf), 9) AS chrf
  FROM rewards GROUP BY ALL)
SELECT 'backward' AS direction, * FROM ({_advantages("rewards", _ROLLOUT_KEYS, "sent_id, fwd_idx")})
UNION ALL SELECT 'forward', * FROM ({_advantages("means", _ROLLOUT_KEYS, "sent_id")})"""
ORACLE["corpus_order"] = """SELECT fmt, row_number() OVER (PARTITION BY fmt ORDER BY doc_id) - 1 AS doc_id,
  CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents, (VALUES ('json'), ('parquet')) AS f(fmt)"""
ORACLE["first_texts"] = """SELECT doc_id, lang, md5(text) AS digest FROM documents ORDER BY digest NULLS FIRST, doc_id LIMIT 100"""


def _rolled(n_forward: int, n_backward: int, every: int) -> str:
    return f"""WITH {SENTENCES},
forth AS (SELECT sent_id, sentence, CAST(k AS INTEGER) AS fwd_idx, {drop_words('sentence', '0', 5)} AS fwd_text
  FROM sentences, range({n_forward}) AS r(k))
SELECT sent_id, 'fr' AS lang, sentence, fwd_idx, fwd_text, CAST(j AS INTEGER) AS bwd_idx,
  {drop_words('fwd_text', '0', every)} AS bwd_text FROM forth, range({n_backward}) AS r(j)"""


ORACLE["sampled_rollouts"] = _rolled(2, 2, 5)
ORACLE["greedy_rollouts"] = _rolled(1, 1, 7)
ORACLE["stored_rollouts"] = ORACLE["greedy_rollouts"]
