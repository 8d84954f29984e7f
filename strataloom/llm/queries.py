"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._util import table
from .decontaminate import contamination
from .jaccard_join import near_duplicates
from .merkle import tamper_audit
from .packing import pack_sequences, packed_pieces
from .quality_classifier import score_quality
from .quality_rules import BIN, LEAST_GROUP, RATIOS, REACH, judge_quality
from .sharding import assign_shards
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats
from .token_count import token_counts
from .token_files import token_digest
from .toxicity import score_toxicity
from .url_filter import PATH_RULES, PATTERN_RULES, judge_urls


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda s, d: score_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op2_jaccard_join": lambda s, d: near_duplicates(table(s, d, "documents")),
    "op3_best_fit_packing": lambda s, d: packed_pieces(pack_sequences(table(s, d, "documents"))),
    "op4_quality_rules": lambda s, d: judge_quality(table(s, d, "documents")),
    "op5_token_files": lambda s, d: token_digest(table(s, d, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2),
    "op6_decontamination": lambda s, d: contamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_quality_classifier": lambda s, d: score_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op8_url_filters": lambda s, d: judge_urls(table(s, d, "pages")),
    "op9_suffix_dedup": lambda s, d: remove_repeats(table(s, d, "documents")),
    "op10_token_counts": lambda s, d: token_counts(table(s, d, "documents"), _tokenizer("piece_bpe_32k.model")),
    "op11_sharding": lambda s, d: assign_shards(table(s, d, "documents")),
    "op12_spelling_variants": lambda s, d: spelling_variants(table(s, d, "documents")),
    "op13_merkle_manifest": lambda s, d: tamper_audit(table(s, d, "documents")),
}

_RULES = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in PATH_RULES)
_BLOCKED = " or ".join(f"regexp_matches(lower(url), '{r.pattern}')" for r in PATTERN_RULES)

_RATIO = {"word_length": "word_chars", "symbol_ratio": "n_symbols", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words"}
_LONG = " union all ".join(f"select r, lang, source, '{k}' ratio, {c} / nullif(n_words, 0)::double v, {RATIOS[k][0]} least, {str(RATIOS[k][1]).lower()} low from d" for k, c in _RATIO.items())


def _quartiles_sql(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name}_b as (select {by}ratio, bin, sum(n) n from sk group by all), {name}_u as (select *, sum(n) over (partition by {by}ratio) rows, sum(n) over (partition by {by}ratio order by bin nulls first rows unbounded preceding) upto from {name}_b),
 {name} as (select {by}ratio, any_value(rows) rows, min(case when upto >= 0.25 * rows then case when bin is null then 0 else pow({BIN}, bin + 0.5) end end) q1, min(case when upto >= 0.75 * rows then case when bin is null then 0 else pow({BIN}, bin + 0.5) end end) q3 from {name}_u group by all)"""


#: crc32's table as one list, and the crc32 of a list of bytes.
_CRC = "crc as materialized (select list(x order by i) t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) x from (select unnest(range(256)) i)))"


def _crc32(of: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_ENCODED = " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars"))
_VALUE = "case when {0} is null then '-' else strlen({0}) || ':' || {0} end"


def _tree_sql(name: str, base: str) -> str:
    """SQL of trees of three: {name} has every node (tree, level, pos, n, d) over the leaves of base, {name}_p each leaf's siblings (tree, pos, level, left, right)."""
    return f"""{name}(tree, level, pos, n, d) as ({base} union all select tree, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' order by pos)) from {name} where n > 1 group by tree, level, pos // 3),
 {name}_p as materialized (select l.tree, l.pos, x.level, coalesce(string_agg(x.d, '' order by x.pos) filter (x.pos < l.pos // (3 ** x.level)::bigint), '') l, coalesce(string_agg(x.d, '' order by x.pos) filter (x.pos > l.pos // (3 ** x.level)::bigint), '') r
 from {name} l join {name} x on x.tree is not distinct from l.tree and x.n > 1 and x.pos // 3 = l.pos // (3 ** (x.level + 1))::bigint where l.level = 0 group by 1, 2, 3)"""


ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": """with recursive t as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda v: v <> '') w from documents),
 b as materialized (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) s from t where len(w) > 0), c as materialized (select s, min(doc_id) set_id, len(s) k from b group by 1),
 x as materialized (select set_id, k, unnest(s) z from c), l as materialized (select a.set_id a, b.set_id b from x a join x b on a.z = b.z and a.set_id < b.set_id group by 1, 2, a.k, b.k having count(*) >= 0.8 * (a.k + b.k - count(*)) - 1e-9),
 y as materialized (select a, b from l union all select b, a from l), r(root, a) as (select set_id, set_id from c union select r.root, y.b from r join y on y.a = r.a), m as (select a, min(root) class_id from r group by 1), n as (select a, count(*) n from y group by 1)
 select t.doc_id, coalesce(c.set_id, t.doc_id) set_id, coalesce(m.class_id, t.doc_id) class_id, coalesce(n.n, 0) n_links from t left join b on b.doc_id = t.doc_id left join c on c.s = b.s left join m on m.a = c.set_id left join n on n.a = c.set_id""",
    "op9_suffix_dedup": """with t as materialized (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents), w as materialized (select doc_id, i, substr(h, 2 * i + 1, 100) s from (select doc_id, h, unnest(range(0, n - 49)) i from t)),
 f as materialized (select s, min(doc_id) m from w group by 1 having count(distinct doc_id) > 1), i as materialized (select w.doc_id, i, i > 50 + lag(i) over (partition by w.doc_id order by i) cut from w join f on f.s = w.s and w.doc_id > f.m),
 g as (select doc_id, i, count(*) filter (coalesce(cut, true)) over (partition by doc_id order by i) k from i), sp as materialized (select doc_id, k, min(i) a, max(i) + 50 z from g group by 1, 2),
 p as (select sp.doc_id, k, a, z, coalesce(lag(z) over (partition by sp.doc_id order by k), 0) before from sp),
 q as (select t.doc_id, any_value(n) n, coalesce(sum(z - a), 0)::bigint n_removed, count(k) n_spans, coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by k), '') || substr(any_value(h), 2 * coalesce(max(z), 0) + 1) kept from t left join p on p.doc_id = t.doc_id group by 1)
 select doc_id, n n_bytes, n_removed, n_spans, sha256(unhex(kept)) kept_sha256 from q""",
    "op12_spelling_variants": f"""with recursive {_CRC}, u as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) run from documents), v as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) c from u where len(run) >= 7 group by 1, 2),
 h as (select run, c, len(run) k, {_crc32("flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda z: case when unicode(z) < 128 then [unicode(z)::bigint] else [192 + (unicode(z) >> 6), 128 + (unicode(z) & 63)]::bigint[] end))")} h from v, crc),
 w as materialized (select case when h % 31 = 0 then left(run, (h % k)::int) || substr(run, (h % k)::int + 2) else run end word, sum(c)::bigint n from h group by 1 having len(word) >= 7 and n >= 2),
 d as materialized (select word, n, p, left(word, p) || substr(word, p + 2) rest from (select word, n, unnest(range(len(word)))::int p from w)), e as (select distinct word, n, rest from d),
 nr as (select a.word, a.n, b.word o, b.n m from d a join d b on a.rest = b.rest and a.p = b.p and a.word <> b.word union all select e.word, e.n, w.word, w.n from e join w on w.word = e.rest union all select w.word, w.n, e.word, e.n from e join w on w.word = e.rest),
 b as (select word, n, count(*) c, arg_min(o, (-m, o)) o, max(m) m from nr group by 1, 2), f as materialized (select w.word, w.n, coalesce(c, 0) n_near, case when m >= 10 * w.n then o end form, case when m >= 10 * w.n then m end form_n from w left join b on w.word = b.word),
 r(word, last_, form) as (select word, word, form from f union all select r.word, f.word, f.form from r join f on f.word = r.form)
 select f.word, f.form, r.last_ root, n, n_near, form_n from f join r on r.word = f.word and r.form is null""",
    "op13_merkle_manifest": f"""with recursive {_CRC}, a as (select doc_id, source, text, row_number() over () id, {_ENCODED} e from documents),
 g as (select doc_id, source, id, sha256(e || {_VALUE.format("text")}) leaf, sha256(e || {_VALUE.format("replace(text, chr(10), '')")}) bare, {_crc32("list_transform(string_split(doc_id::varchar, ''), lambda z: ascii(z)::bigint)")} % 2 = 0 hit from a, crc),
 o as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf, id) - 1 pos, count(*) over (partition by source) n from g),
 {_tree_sql("t", "select source, 0, pos, n, leaf from o")}, top as (select tree source, d subroot, row_number() over (order by tree nulls first) - 1 pos, count(*) over () n from t where n = 1),
 {_tree_sql("s", "select 'all', 0, pos, n, subroot from top")}, path as (select tree source, pos, list({{'l': l, 'r': r}} order by level) p from t_p group by 1, 2), up as (select pos, list({{'l': l, 'r': r}} order by level) p from s_p group by 1),
 z as (select o.doc_id, leaf, case when hit then bare else leaf end found, subroot, (select d from s where n = 1) root, list_concat(coalesce(path.p, []), coalesce(up.p, [])) p
 from o join top on top.source is not distinct from o.source left join path on path.source is not distinct from o.source and path.pos = o.pos left join up on up.pos = top.pos),
 q as (select *, sha256(list_aggregate(list_prepend('', list_transform(p, lambda x: x.l || x.r)), 'string_agg', '')) proof_sha256, list_reduce(list_prepend({{'l': '', 'r': found}}, p), lambda c, x: {{'l': '', 'r': sha256(x.l || c.r || x.r)}}).r folded_root from z)
 select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from q""",
    "op4_quality_rules": f"""with t as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') x from documents), w as (select r, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') w from t),
 ln as (select r, unnest(string_split(x, chr(10))) l from t), lc as (select r, count(*) - count(distinct l) dup from ln where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
 win as (select r, i, w[i:i + 7] v from (select r, w, unnest(range(1, greatest(1, len(w) - 6))) i from w)), again as (select r, v from win group by 1, 2 having count(*) > 1),
 rp as (select r, count(distinct p) n from (select win.r, unnest(range(i, i + 8)) p from win join again on win.r = again.r and win.v = again.v) group by 1),
 c as (select t.r r, doc_id, lang, source, len(w.w)::bigint n_words, coalesce(list_sum(list_transform(w.w, lambda z: length(z))), 0)::bigint word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
 coalesce(lc.dup, 0)::bigint n_dup_lines, coalesce(rp.n, 0)::bigint n_repeat_words from t join w on t.r = w.r left join lc on t.r = lc.r left join rp on t.r = rp.r),
 e as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from c), d as (select * from e where not base_failed), lo as ({_LONG}),
 sk as (select lang, source, ratio, case when v > 0 then floor(ln(v) / {math.log(BIN)!r}) end bin, count(*) n from lo group by all),
 {_quartiles_sql('own', 'lang, source')}, {_quartiles_sql('lng', 'lang')}, {_quartiles_sql('evr', '')},
 q as (select own.lang, own.source, own.ratio, case when own.rows >= {LEAST_GROUP} then own.q1 when lng.rows >= {LEAST_GROUP} then lng.q1 else evr.q1 end q1, case when own.rows >= {LEAST_GROUP} then own.q3 when lng.rows >= {LEAST_GROUP} then lng.q3 else evr.q3 end q3
 from own join lng on own.lang is not distinct from lng.lang and own.ratio = lng.ratio join evr on evr.ratio = own.ratio),
 bad as (select distinct r from lo join q on lo.lang is not distinct from q.lang and lo.source is not distinct from q.source and lo.ratio = q.ratio where v > q3 + {REACH} * greatest(q3 - q1, least) or low and v < q1 - {REACH} * greatest(q3 - q1, least))
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from bad) kept from e""",
    "op6_decontamination": """with t as (select doc_id, row_number() over () r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda v: v <> '') w from documents),
 b as (select item_id::varchar item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda v: v <> '') w from benchmark),
 bw as (select distinct item, len(x) n, x from (select item, w[i:i + 9] x from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) i from b where len(w) > 0))),
 lens as (select distinct n from bw), dw as (select r, i, n, w[i:i + n - 1] x from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from t, lens)),
 h as (select dw.r, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.x = bw.x),
 c as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from h) group by 1), m as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) s from h group by 1)
 select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from t left join c on t.r = c.r left join m on t.r = m.r""",
    "op8_url_filters": f"""with rules(action, host, path) as (values {_RULES}), p as (select page_id, row_number() over () r, url, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') rest from pages),
 q as (select page_id, r, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from p),
 f as (select r, arg_max(rules.host || rules.path, len(rules.host || rules.path)) as rule, arg_max(action, len(rules.host || rules.path)) action from q join rules
 on (q.host = rules.host or ends_with(q.host, '.' || rules.host)) and starts_with(q.path, rules.path) group by 1)
 select page_id, host, path, f.rule as rule, coalesce(action, case when {_BLOCKED} then 'block' else 'allow' end) verdict from q left join f on q.r = f.r""",
}
