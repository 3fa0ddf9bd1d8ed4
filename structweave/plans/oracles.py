"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations


def _ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


# Documents ------------------------------------------------------------------------------------------

LINES = """lines as (
  select doc_id, unnest(range(len(a))) as line_no, unnest(a) as line
  from (select doc_id, string_split(text, chr(10)) as a from documents))"""

TOKENS = """words as (
  select doc_id, line_no, [x for x in string_split(line, ' ') if x <> ''] as ws from lines),
raw as (
  select doc_id, line_no, len(ws) as len, unnest(range(len(ws))) as pos, unnest(ws) as word from words),
tokens as (
  select doc_id, line_no, pos, len, word,
    case when regexp_matches(word, '^[0-9]') then 'NUM' when regexp_matches(word, '^[A-Z]') then 'CAP'
         when regexp_matches(word, '^[a-z]') then 'LOW' else 'OTH' end as pos_tag,
    case when pos = 0 then 'B' when pos = len - 1 then 'E' else 'I' end as chunk_tag,
    case when contains(word, '@') then 'MAIL' when regexp_matches(word, '[0-9]') then 'NUM'
         when ends_with(word, '.') then 'END' when pos > 0 and regexp_matches(word, '^[A-Z]') then 'CAP'
         else 'O' end as tag
  from raw)"""

VOCAB = """firsts as (
  select word, count(*) as n, min({'a': doc_id, 'b': line_no, 'c': pos}) as first from tokens group by word),
vocab as (
  select word, row_number() over (order by first) as id, n from firsts where n > 2)"""

TAGS = """kinds as (
  select 'pos' as kind, pos_tag as tag, doc_id, line_no, pos from tokens
  union all select 'chunk', chunk_tag, doc_id, line_no, pos from tokens
  union all select 'tag', tag, doc_id, line_no, pos from tokens),
tag_firsts as (select kind, tag, min({'a': doc_id, 'b': line_no, 'c': pos}) as first from kinds group by kind, tag),
tag_ids as (select kind, tag, row_number() over (partition by kind order by first, tag) - 1 as id from tag_firsts)"""

MARKED = """marked as (
  select doc_id, line_no, starts_with(line, 'Licensed ') as mark,
         coalesce(lag(starts_with(line, 'Licensed ')) over (partition by doc_id order by line_no), false) as after_mark,
         [x for x in string_split(line, ' ') if x <> ''] as ws
  from lines),
sentences as (
  select doc_id, line_no, case when after_mark then ws[2:] else ws end as ws, after_mark and len(ws) = 0 as closed
  from marked where not mark)"""

CORPUS = {
    "corpus_scan": _ctes(LINES, MARKED)
    + """, placed as (select unnest(range(len(ws))) as pos, unnest(ws) as word from sentences)
select pos, word, 'P' as pos_tag, 'C' as chunk_tag, case when ends_with(word, '.') then 'END' else 'O' end as tag,
  count(*) as n
from placed group by pos, word""",
    "sentence_count": _ctes(LINES, MARKED)
    + "select count(*) as n_sentences from sentences where not closed",
    "sentence_lengths": _ctes(LINES, MARKED)
    + "select len(ws) as n_tokens, count(*) as n_sentences from sentences where len(ws) > 0 group by 1",
    "word_count": _ctes(LINES, TOKENS) + "select word, count(*) as n from tokens group by word",
    "vocabulary": _ctes(LINES, TOKENS, VOCAB)
    + """select word, id, n, false as reserved from vocab
union all select * from (values ('<unk>', 0, 0, true), ('START', -1, 0, true), ('STOP', -2, 0, true))""",
    "tag_dictionary": _ctes(LINES, TOKENS, TAGS)
    + """select kind, tag, id, false as reserved from tag_ids
union all select kind, tag, id, true from
  (select unnest(['pos', 'chunk', 'tag']) as kind) k, (values ('START', -1), ('STOP', -2)) v(tag, id)""",
    "encode_words": _ctes(LINES, TOKENS, VOCAB)
    + """select doc_id, line_no, pos, coalesce(id, 0) as word_id from tokens left join vocab using (word)""",
    "inverse_words": _ctes(LINES, TOKENS, VOCAB)
    + """select case when id is null then '<unk>' else word end as word, count(*) as n_tokens
from tokens left join vocab using (word) group by 1""",
    "unknown_tags": _ctes(LINES, TOKENS)
    + """, affixed as (select doc_id, right(word, 2) as p, left(word, 1) as c, tag from tokens),
stacked as (
  select doc_id, 'pos' as kind, p as tag from affixed union all select doc_id, 'chunk', c from affixed
  union all select doc_id, 'tag', tag from affixed)
select kind, tag, count(*) as n from stacked
where (kind, tag) not in (select (kind, tag) from stacked where doc_id in (select doc_id from labels))
group by kind, tag""",
    "encoded_sequences": _ctes(LINES, TOKENS, VOCAB, TAGS)
    + """select doc_id, line_no, pos // 4096 as seg, any_value(t.len) as len,
  string_agg(cast(coalesce(v.id, 0) as varchar), ',' order by pos) as words,
  string_agg(cast(p.id as varchar), ',' order by pos) as pos_tags,
  string_agg(cast(c.id as varchar), ',' order by pos) as chunks,
  string_agg(cast(g.id as varchar), ',' order by pos) as tags
from tokens t left join vocab v using (word)
join tag_ids p on p.kind = 'pos' and p.tag = t.pos_tag
join tag_ids c on c.kind = 'chunk' and c.tag = t.chunk_tag
join tag_ids g on g.kind = 'tag' and g.tag = t.tag
group by doc_id, line_no, pos // 4096""",
    "shared_dictionary_load": _ctes(LINES, TOKENS)
    + """, train_words as (
  select word, count(*) as n, min({'a': doc_id, 'b': line_no, 'c': pos}) as first from tokens
  where doc_id in (select doc_id from labels) group by word),
ids as (select word, row_number() over (order by first) as id from train_words where n > 2)
select case when doc_id in (select doc_id from labels) then 'train' else 'dev' end as split, count(*) as n_tokens,
  count(*) filter (id is null) as n_unknown, cast(sum(coalesce(id, 0)) as bigint) as id_sum
from tokens left join ids using (word) group by 1""",
}

SHUFFLE = """started as (select o_orderkey as k, (o_orderkey % 2147483647 + 7919) % 2147483647 as h0 from orders),
first_mix as (select k, (h0 * 48271) % 2147483647 as h1 from started),
mixed as (select k, (((h1 + h1 // 65536) % 2147483647) * 69621) % 2147483647 as h from first_mix),
ranked as (select k, row_number() over (order by h, k) - 1 as r, count(*) over () as n from mixed)"""

CORPUS["shuffled_rank"] = _ctes(SHUFFLE) + "select k as group_id, r as rank from ranked"
CORPUS["split_train_val"] = (
    _ctes(SHUFFLE) + "select k as group_id, case when r < (3 * n) // 4 then 'train' else 'val' end as split from ranked"
)

# Candidates -----------------------------------------------------------------------------------------

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount"

CANDS = f"""base as (
  select l_orderkey as group_id, l_linenumber as linenumber, l_partkey as partkey, l_suppkey as suppkey,
    l_extendedprice as price, l_quantity / 50e0 as iou, l_extendedprice / 1e5 as x0, l_discount * 10e0 as x1,
    l_tax * 10e0 as x2, 1e0 as x3, row_number() over (partition by l_orderkey order by {_ORDER}) - 1 as cand
  from lineitem),
cands as (
  select *, score + (1e0 - iou) as aug
  from (select *, x0 * 0.7e0 + x1 * 0.3e0 + x2 * -0.2e0 + x3 * 0.1e0 as score from base)),
golds as (select * from (
  select *, row_number() over (partition by group_id order by iou desc, cand) as g from cands) where g = 1),
tops as (select * from (
  select *, row_number() over (partition by group_id order by aug desc, cand) as rank from cands)),
picks as (select * from (
  select *, row_number() over (partition by group_id order by score desc, cand) as p from cands) where p = 1)"""

SMOOTH = """topk as (
  select *, sum(aug) over (partition by group_id order by rank) as cum,
    lead(aug) over (partition by group_id order by rank) as nxt from tops where rank <= 5),
stops as (
  select group_id, min(rank) as stop from topk where nxt is null or cum - rank * nxt >= 0.5e0 group by group_id),
weighted as (
  select t.*, greatest(0e0, t.aug / 0.5e0 + (1e0 - s.cum / 0.5e0) / s.rank) as weight
  from topk t join stops using (group_id) join topk s on s.group_id = t.group_id and s.rank = stop),
smoothed as (
  select w.group_id, max(w.aug) - any_value(g.aug) as hinge, sum(w.weight * w.aug) - any_value(g.aug) as smooth
  from weighted w join golds g using (group_id) group by w.group_id)"""

_KEYS = "group_id, linenumber, partkey, suppkey"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 9) + 0e0 as {name}"


def _vector(prefix: str, source: str, dim: int = 4) -> str:
    parts = [f"select {j} as idx, {_r(prefix.format(j=j), 'value')} {source}" for j in range(dim)]
    return "\nunion all ".join(parts)


CANDIDATES = {
    "candidate_scores": _ctes(CANDS) + f"select {_KEYS}, price, {_r('score', 'score')}, {_r('aug', 'aug')} from cands",
    "candidate_truncate": _ctes(CANDS) + f"select {_KEYS}, cand as cand_id from cands where cand < 3",
    "candidate_gold": _ctes(CANDS) + f"select {_KEYS}, {_r('iou', 'iou')} from golds",
    "candidate_relevance": """select l_orderkey as group_id, count(*) filter (l_quantity / 50e0 > 0.5e0) as n_relevant,
  count(*) as n from lineitem group by 1""",
    "candidate_argmax": _ctes(CANDS) + f"select {_KEYS}, {_r('aug', 'aug')} from tops where rank = 1",
    "candidate_topk": _ctes(CANDS) + f"select {_KEYS}, rank, {_r('aug', 'aug')} from tops where rank <= 5",
    "simplex_weights": _ctes(CANDS, SMOOTH) + f"select group_id, rank, {_r('weight', 'weight')} from weighted",
    "candidate_hinge": _ctes(CANDS)
    + f"""select c.group_id, {_r('max(c.aug) - any_value(g.aug)', 'hinge')}
from cands c join golds g using (group_id) group by c.group_id""",
    "candidate_smoothed_hinge": _ctes(CANDS, SMOOTH)
    + f"select group_id, {_r('hinge', 'hinge')}, {_r('smooth', 'smooth')} from smoothed",
    "candidate_batch_loss": _ctes(CANDS, SMOOTH)
    + f"select {_r('avg(hinge)', 'hinge')}, {_r('avg(smooth)', 'smooth')}, count(*) as n from smoothed",
    "candidate_subgradient": _ctes(CANDS)
    + _vector("avg(t.x{j} - g.x{j})", "from tops t join golds g using (group_id) where t.rank = 1"),
    "candidate_smoothed_gradient": _ctes(
        CANDS,
        SMOOTH,
        """per_group as (
  select group_id, sum(weight * x0) as x0, sum(weight * x1) as x1, sum(weight * x2) as x2, sum(weight * x3) as x3
  from weighted group by group_id)""",
    )
    + _vector("avg(t.x{j} - g.x{j})", "from per_group t join golds g using (group_id)"),
    "candidate_lmo": _ctes(CANDS)
    + "select t.group_id, "
    + ", ".join(_r(f"g.x{j} - t.x{j}", f"psi{j}") for j in range(4))
    + f", {_r('1e0 - t.iou', 'loss')} from tops t join golds g using (group_id) where t.rank = 1",
    "candidate_predict": _ctes(CANDS) + f"select {_KEYS}, {_r('score', 'score')}, {_r('iou', 'iou')} from picks",
    "candidate_mean_iou": _ctes(CANDS) + f"select {_r('avg(iou)', 'mean_iou')} from picks",
    "candidate_accuracy": _ctes(CANDS)
    + f"select {_r('avg(case when iou >= 0.5e0 then 1e0 else 0e0 end)', 'accuracy')} from picks",
    "candidate_micro_ap": _ctes(
        CANDS,
        """cells as (
  select round(score, 9) + 0e0 as s, count(*) as n, count(*) filter (iou > 0.5e0) as hits from cands group by 1
  union all select 0e0, (select sum(1000 - c) from (select count(*) as c from cands group by group_id)), 0),
steps as (select s, sum(n) as n, sum(hits) as hits from cells group by s),
running as (select hits, sum(n) over (order by s desc) as seen, sum(hits) over (order by s desc) as found from steps)""",
    )
    + f"select {_r('sum(hits * (found * 1e0 / seen)) / sum(hits)', 'average_precision')} from running",
}

# Binary ---------------------------------------------------------------------------------------------

EXAMPLES = """exploded as (
  select vec_id as id, case when label < 5 then 1e0 else 0e0 end as y, unnest(range(len(embedding))) as j,
    cast(unnest(embedding) as double) as x
  from embeddings),
margins as (
  select id, any_value(y) as y, sum(x * ((((7 * j) % 11) - 5) / 10e0)) as z from exploded group by id),
losses as (
  select id, y, z, greatest(z, 0e0) + ln(1e0 + exp(-abs(z))) - y * z as loss, 1e0 / (1e0 + exp(-z)) - y as residual
  from margins),
gradient as (
  select j as idx, sum(residual * x) / (select count(*) from margins) as value
  from exploded join losses using (id) group by j)"""

MEANS = """class_mean as (select j, avg(x) as w from exploded where y = 1 group by j),
all_mean as (select j, avg(x) as c from exploded group by j)"""

BINARY = {
    "dense_examples": """with e as (
  select vec_id, label, unnest(embedding) as x, len(embedding) as dim from embeddings)
select vec_id, any_value(dim) as dim, round(sum(cast(x as double)), 9) + 0e0 as total,
  case when any_value(label) = 3 then 1e0 else 0e0 end as y from e group by vec_id""",
    "logistic_rows": _ctes(EXAMPLES) + f"select id, {_r('loss', 'loss')}, {_r('residual', 'residual')} from losses",
    "logistic_loss": _ctes(EXAMPLES) + f"select {_r('avg(loss)', 'loss')}, count(*) as n from losses",
    "logistic_gradient": _ctes(EXAMPLES) + f"select idx, {_r('value', 'value')} from gradient",
    "logistic_error": _ctes(EXAMPLES) + f"select {_r('avg(abs((1 + sign(z)) / 2e0 - y))', 'error')} from margins",
    "l2_penalty": _ctes(EXAMPLES, MEANS)
    + f"select {_r('0.05e0 * sum((w - c) * (w - c))', 'penalty')} from class_mean join all_mean using (j)",
    "objective": _ctes(EXAMPLES, MEANS)
    + f"""select {_r('(select avg(loss) from losses) + (select 0.05e0 * sum(w * w) from class_mean)', 'objective')}""",
    "gradient_norm": _ctes(EXAMPLES) + f"select {_r('sqrt(sum(value * value))', 'norm')} from gradient",
}

# Sequences ------------------------------------------------------------------------------------------

EVENTS = """ev as (
  select user_id, strftime(ts, '%Y-%m-%d') as d,
    row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as pos,
    count(*) over (partition by user_id, cast(ts as date)) as len,
    cast(floor(value / 50e0) as bigint) as w, cast(floor(hour(ts) / 6e0) as bigint) as p, event_id % 3 as c,
    case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as y
  from events),
ctx as (
  select *, coalesce(lag(w) over q, -1) as w_m1, lag(w, 2) over q as w_m2,
    coalesce(lead(w) over q, -2) as w_n1, lead(w, 2) over q as w_n2,
    coalesce(lag(p) over q, -1) as p_m1, coalesce(lead(p) over q, -2) as p_n1,
    coalesce(lag(c) over q, -1) as c_m1, coalesce(lead(c) over q, -2) as c_n1, coalesce(lag(y) over q, -1) as y1
  from ev window q as (partition by user_id, d order by pos))"""


def _hash(slot: int, a2: str, a3: str) -> str:
    code = f"506447 + 961 * {slot} + 31 * {a2} + {a3}"
    return f"((({code}) % 997 + 997) % 997)"


def _slots(cur: str, prev: str) -> str:
    """The 27 hashed indices of a position as a list, spelled out slot by slot."""
    h = _hash
    slots = [
        h(0, "w", cur), h(1, "w", prev),
        f"case when w_m2 is null then 0 else {h(2, 'w_m2', cur)} end",
        f"case when w_m2 is null then 0 else {h(3, 'w_m2', prev)} end",
        f"case when w_n2 is null then 0 else {h(4, 'w_n2', cur)} end",
        f"case when w_n2 is null then 0 else {h(5, 'w_n2', prev)} end",
        h(6, "w_m1", cur), h(7, "w_m1", prev), h(8, "w_n1", cur), h(9, "w_n1", prev), h(10, prev, cur),
        h(11, "p_m1", "p"), h(12, "p", "p_n1"), h(13, "c_m1", "c"), h(14, "c", "c_n1"),
        h(15, cur, "p"), h(16, cur, "p_n1"), h(17, cur, "p_m1"), h(18, cur, "c"), h(19, cur, "c_n1"), h(20, cur, "c_m1"),
        h(21, prev, "p"), h(22, prev, "p_n1"), h(23, prev, "p_m1"), h(24, prev, "c"), h(25, prev, "c_n1"),
        h(26, prev, "c_m1"),
    ]
    return "[" + ", ".join(slots) + "]"


_W = "(((i * 37) % 101 - 50) / 64e0)"

GOLD = f"""gold_idx as (select user_id, d, pos, {_slots('y', 'y1')} as idx from ctx),
gold_counts as (
  select user_id, d, idx, count(*) as n from (select user_id, d, unnest(idx) as idx from gold_idx) group by all),
gold_score as (
  select user_id, d, sum(n * (((idx * 37) % 101 - 50) / 64e0)) as gold from gold_counts group by user_id, d)"""


def _edges(loss: int) -> str:
    return f"""pairs as (
  select ctx.* exclude (y, y1), ctx.y as gold, a.y, b.y1
  from ctx, (select unnest(range(5)) as y) a, (select unnest(range(-1, 5)) as y1) b where (b.y1 = -1) = (ctx.pos = 0)),
edges as (
  select user_id, d, pos, len, y1, y,
    list_sum([{_W} for i in {_slots('y', 'y1')}]) + {loss} * (case when y = gold then 0 else 1 end) as score
  from pairs)"""


def _viterbi(loss: int, k: int) -> str:
    """Recursion over positions; per tag the k best (score, reversed path) in the tie order of the library."""
    return f"""{_edges(loss)},
steps as (
  select user_id, d, 0 as pos, y, score as s, [y] as back from edges where pos = 0
  union all
  select user_id, d, pos, y, u.s, u.back from (
    select user_id, d, pos, y, unnest(best) as u from (
      select e.user_id, e.d, e.pos, e.y,
        list({{'s': v.s + e.score, 'back': list_prepend(e.y, v.back)}}
             order by v.s + e.score desc, list_prepend(e.y, v.back))[1:{k}] as best
      from steps v join edges e on e.user_id = v.user_id and e.d = v.d and e.pos = v.pos + 1 and e.y1 = v.y
      group by e.user_id, e.d, e.pos, e.y))),
ends as (
  select s.user_id, s.d, s.s, s.back,
    row_number() over (partition by s.user_id, s.d order by s.s desc, s.back) as rank
  from steps s join (select distinct user_id, d, len from ev) l on l.user_id = s.user_id and l.d = s.d and s.pos = l.len - 1),
paths as (select user_id, d, rank, s as score, list_reverse(back) as path from ends where rank <= {k})"""


def _decoded(loss: int, k: int) -> str:
    return "with recursive " + EVENTS + ",\n" + _viterbi(loss, k)


PATH_TOKENS = """path_tokens as (
  select user_id, d, rank, unnest(range(len(path))) as pos, unnest(path) as y,
    unnest(list_prepend(-1, path[:len(path) - 1])) as y1
  from paths)"""

PATH_COUNTS = f"""{PATH_TOKENS},
path_idx as (
  select t.user_id, t.d, t.rank, unnest({_slots('t.y', 't.y1')}) as idx
  from path_tokens t join ctx on ctx.user_id = t.user_id and ctx.d = t.d and ctx.pos = t.pos),
path_counts as (select user_id, d, rank, idx, count(*) as n from path_idx group by all)"""

SEQ_SMOOTH = """scored as (
  select user_id, d, rank, score, sum(score) over q as cum, lead(score) over q as nxt
  from paths window q as (partition by user_id, d order by rank)),
stops as (
  select user_id, d, min(rank) as stop from scored where nxt is null or cum - rank * nxt >= 2e0 group by user_id, d),
weighted as (
  select t.user_id, t.d, t.rank, t.score, greatest(0e0, t.score / 2e0 + (1e0 - s.cum / 2e0) / s.rank) as weight
  from scored t join stops p on p.user_id = t.user_id and p.d = t.d
  join scored s on s.user_id = t.user_id and s.d = t.d and s.rank = p.stop)"""

_PATH = "array_to_string(path, '') as path"

_GRADIENT = """parts as (
  select idx, {weight} * n as v from path_counts {join}
  union all select idx, -n from gold_counts),
means as (select idx, round(sum(v) / (select count(*) from gold_score), 9) + 0e0 as value from parts group by idx)"""

SEQUENCES = {
    "context_window": _ctes(EVENTS)
    + "select user_id, d, pos, w, w_m1, coalesce(w_m2, -99) as w_m2, w_n1, coalesce(w_n2, -99) as w_n2, p, p_m1, p_n1, c, c_m1, c_n1, y, y1 from ctx",
    "hashed_features": _ctes(EVENTS, GOLD) + "select user_id, d, pos, array_to_string(idx, ',') as idx from gold_idx",
    "sequence_feature_counts": _ctes(EVENTS, GOLD) + "select user_id, d, idx, n from gold_counts",
    "edge_scores": _ctes(EVENTS, _edges(1)) + "select user_id, d, pos, y1, y, score from edges",
    "largest_edges": _ctes(EVENTS, _edges(0))
    + """select user_id, d, pos, rank, y1, y, score from (
  select *, row_number() over (partition by user_id, d, pos order by score desc, y1, y) as rank from edges)
where rank <= 3""",
    "sequence_score": _ctes(EVENTS, GOLD) + "select user_id, d, gold as score from gold_score",
    "viterbi_path": _decoded(1, 1) + f"select user_id, d, score, {_PATH} from paths",
    "viterbi_topk": _decoded(1, 3) + f"select user_id, d, rank, score, {_PATH} from paths",
    "predict_tags": _decoded(0, 1)
    + f""", {PATH_TOKENS}
select t.user_id, t.d, t.pos, e.y as tag, t.y as predicted
from path_tokens t join ev e on e.user_id = t.user_id and e.d = t.d and e.pos = t.pos""",
    "hamming": _decoded(0, 1)
    + f""", {PATH_TOKENS}
select t.user_id, t.d, count(*) filter (e.y <> t.y) as distance
from path_tokens t join ev e on e.user_id = t.user_id and e.d = t.d and e.pos = t.pos group by t.user_id, t.d""",
    "weighted_f1": _decoded(0, 1)
    + f""", {PATH_TOKENS},
pairs_seen as (
  select e.y as tag, t.y as predicted
  from path_tokens t join ev e on e.user_id = t.user_id and e.d = t.d and e.pos = t.pos),
per_tag as (
  select k, count(*) filter (tag = k) as support, count(*) filter (predicted = k) as claimed,
    count(*) filter (tag = k and predicted = k) as hits
  from pairs_seen, (select unnest(range(1, 5)) as k) group by k)
select {_r('sum(case when support + claimed = 0 then 0e0 else 2e0 * hits / (support + claimed) end * support) / sum(support)', 'weighted_f1')}
from per_tag""",
    "sequence_hinge": _decoded(1, 1)
    + f""", {GOLD}
select p.user_id, p.d, {_r('p.score - g.gold', 'hinge')}
from paths p join gold_score g on g.user_id = p.user_id and g.d = p.d""",
    "sequence_smoothed_hinge": _decoded(1, 3)
    + f""", {GOLD}, {SEQ_SMOOTH}
select w.user_id, w.d, {_r('max(w.score) - any_value(g.gold)', 'hinge')},
  {_r('sum(w.score * w.weight) - any_value(g.gold)', 'smooth')}
from weighted w join gold_score g on g.user_id = w.user_id and g.d = w.d group by w.user_id, w.d""",
    "sequence_subgradient": _decoded(1, 1)
    + f""", {GOLD}, {PATH_COUNTS}, {_GRADIENT.format(weight='1e0', join='')}
select idx, value from means where value <> 0""",
    "sequence_smoothed_gradient": _decoded(1, 3)
    + f""", {GOLD}, {PATH_COUNTS}, {SEQ_SMOOTH},
{_GRADIENT.format(weight='weight', join='join weighted using (user_id, d, rank)')}
select idx, value from means where value <> 0""",
    "sequence_lmo": _decoded(1, 1)
    + f""", {GOLD}, {PATH_COUNTS},
signed as (
  select user_id, d, idx, n from gold_counts union all select user_id, d, idx, -n from path_counts),
psi as (select user_id, d, idx, cast(sum(n) as bigint) as v from signed group by all),
text as (
  select user_id, d, string_agg(idx || ':' || v, ',' order by idx) as psi from psi where v <> 0 group by user_id, d),
losses as (
  select t.user_id, t.d, count(*) filter (e.y <> t.y) as loss
  from path_tokens t join ev e on e.user_id = t.user_id and e.d = t.d and e.pos = t.pos group by t.user_id, t.d)
select l.user_id, l.d, coalesce(text.psi, '') as psi, l.loss
from losses l left join text on text.user_id = l.user_id and text.d = l.d""",
}

# Training -------------------------------------------------------------------------------------------

SMALL = """small as materialized (
  select d.doc_id as id, ln(1e0 + d.n_chars) / 10e0 as x0, case when d.lang = 'en' then 1e0 else 0e0 end as x1,
    cast(l.toxic as double) as x2, 1e0 as x3, cast(l.quality as double) as y
  from documents d join labels l on d.doc_id = l.doc_id)"""


def _mix(key: str, seed: int) -> str:
    """Two multiplicative steps modulo 2^31 - 1 with the upper half folded in between."""
    m = 2147483647
    one = f"((({key} % {m} + {seed} * 7919) % {m}) * 48271) % {m}"
    return f"((({one}) + ({one}) // 65536) % {m} * 69621) % {m}"


class _Steps:
    """Unrolled solver steps as CTEs; a vector is a one-row CTE with columns v0..v3."""

    def __init__(self, buckets: int):
        self.parts = [SMALL, f"ex as materialized (select *, ({_mix('id', 0)}) % {buckets} as bucket from small)"]
        self.fresh = 0
        self.residual = "(1e0 / (1e0 + exp(-({z}))) - y)"  # what a row's features are weighted by in the gradient

    def vector(self, columns: str, source: str) -> str:
        self.fresh += 1
        name = f"t{self.fresh}"
        self.parts.append(f"{name} as materialized (select {columns} {source})")
        return name

    def gradient(self, w: str, bucket: int | None, squared: bool = False) -> str:
        z = " + ".join(f"x{j} * {w}.v{j}" for j in range(4))
        residual = f"({z} - y)" if squared else self.residual.format(z=z)
        chosen = "" if bucket is None else f" where bucket = {bucket}"
        return self.vector(", ".join(f"avg({residual} * x{j}) as v{j}" for j in range(4)), f"from ex, {w}{chosen}")

    def combine(self, terms: list[tuple[str, str]]) -> str:
        """Linear combination of vectors."""
        columns = ", ".join(" + ".join(f"({c}) * {v}.v{j}" for c, v in terms) + f" as v{j}" for j in range(4))
        return self.vector(columns, "from " + ", ".join(dict.fromkeys(v for _, v in terms)))

    def zero(self) -> str:
        return self.vector("0e0 as v0, 0e0 as v1, 0e0 as v2, 0e0 as v3", "")

    def objective(self, w: str, strength: str) -> str:
        """Mean logistic loss plus the l2 penalty at ``w``, as a one-row CTE with column v."""
        z = "(" + " + ".join(f"x{j} * {w}.v{j}" for j in range(4)) + ")"
        square = " + ".join(f"any_value({w}.v{j}) * any_value({w}.v{j})" for j in range(4))
        loss = f"avg(greatest({z}, 0e0) + ln(1e0 + exp(-abs({z}))) - y * {z})"
        return self.vector(f"{loss} + {strength} / 2e0 * ({square}) as v", f"from ex, {w}")

    def finish(self, w: str) -> str:
        rows = " union all ".join(f"select {j} as idx, round(v{j}, 9) + 0e0 as w from {w}" for j in range(4))
        return _ctes(*self.parts) + rows


def _sgd() -> str:
    s = _Steps(4)
    w = mean = s.zero()
    for t, bucket in enumerate([0, 1, 2, 3, 1, 2, 3, 0]):
        g = s.gradient(w, bucket)
        rate = f"(0.5e0 / (1e0 + {t} / 10e0))"
        w = s.combine([(f"1e0 - {rate} * 0.01e0", w), (f"-{rate}", g)])
        mean = s.combine([(f"{t}e0 / {t + 2}e0", mean), (f"2e0 / {t + 2}e0", w)])
    return s.finish(mean)


def _reduced_epoch(
    s: _Steps, start: str, order: list[int], rate: str, kappa: str, centre: str, strength: str = "0.01e0"
) -> str:
    """Inner epoch from ``start``; penalty strength/2 |w|^2 + kappa/2 |w - centre|^2; returns the mean iterate."""
    full = s.gradient(start, None)
    w = start
    seen = []
    for bucket in order:
        here, there = s.gradient(w, bucket), s.gradient(start, bucket)
        w = s.combine(
            [(f"1e0 - {rate} * ({strength} + {kappa})", w), (f"{rate} * {kappa}", centre), (f"-{rate}", here),
             (rate, there), (f"-{rate}", full)]
        )
        seen.append(w)
    return s.combine([(f"1e0 / {len(order)}e0", v) for v in seen])


def _svrg() -> str:
    s = _Steps(3)
    w = s.zero()
    for order in ([0, 1, 2], [1, 2, 0]):
        w = _reduced_epoch(s, w, order, "0.5e0", "0e0", w)
    return s.finish(w)


def _accelerated() -> str:
    s = _Steps(2)
    lam = "0.01e0"
    alpha = f"sqrt({lam} / ({lam} + 0.05e0))"
    mean = before = centre = centre_before = s.zero()
    for epoch, order in enumerate([[0, 1], [1, 0], [0, 1]]):
        kappa = f"({epoch + 1} * 0.05e0)"
        r, r1 = f"({kappa} + {lam})", f"({epoch + 2} * 0.05e0 + {lam})"
        pull = f"({kappa} / {r})"
        start = s.combine([("1e0", mean), (pull, centre), (f"-{pull}", centre_before)])
        mean = _reduced_epoch(s, start, order, f"(1e0 / (1e0 + {r}))", kappa, centre)
        scalar = s.vector(f"{alpha} as a", "")
        a = f"(select a from {scalar})"
        following = s.vector(
            f"({lam} - {a} * {a} * {r} + sqrt(power({a} * {a} * {r} - {lam}, 2) + 4e0 * {r} * {r1} * {a} * {a}))"
            f" / (2e0 * {r1}) as a",
            "",
        )
        alpha = f"(select a from {following})"
        beta = f"({a} * (1e0 - {a}) * {r} / ({a} * {a} * {r} + {alpha} * {r1}))"
        factor = s.vector(f"{beta} as b", "")
        centre_before = centre
        centre = s.combine([(f"1e0 + (select b from {factor})", mean), (f"-(select b from {factor})", before)])
        before = mean
    return s.finish(mean)


FOUR = ([0, 1, 2, 3], [1, 2, 3, 0], [2, 3, 0, 1])


def _train_log() -> str:
    """The objective before and after each of three passes; the gradient norm never gets below the stop rule's bound."""
    s = _Steps(4)
    w = s.zero()
    values = [s.objective(w, "0.01e0")]
    for order in FOUR:
        w = _reduced_epoch(s, w, order, "0.5e0", "0e0", w)
        values.append(s.objective(w, "0.01e0"))
    rows = (f"select {e} as epoch, 'train' as split, 'objective' as metric, round(v, 9) + 0e0 as value from {v}" for e, v in enumerate(values))
    return _ctes(*s.parts) + " union all ".join(rows)


def _own_loss() -> str:
    """Gradient steps of the squared error, each taken only while the weights sum up to less than 0.3."""
    s = _Steps(1)
    w = s.zero()
    for _ in range(20):
        go = f"(select case when v0 + v1 + v2 + v3 >= 0.3e0 then 0e0 else 1e0 end from {w})"
        g = s.gradient(w, None, squared=True)
        w = s.combine([(f"1e0 - {go} * 0.1e0 * 0.02e0", w), (f"-{go} * 0.1e0", g)])
    return s.finish(w)


def _own_smoothed() -> str:
    """Three outer steps of a smoothed absolute error, whose coefficient falls from step to step; one inner step each."""
    s = _Steps(1)
    lam, kappa, r = "0.02e0", "0.05e0", "0.07e0"
    mean = before = centre = s.zero()
    alpha = f"sqrt({lam} / {r})"
    for epoch in range(3):
        s.residual = f"greatest(-1e0, least(1e0, ({{z}} - y) / (2e0 / {epoch + 1}e0)))"
        mean = _reduced_epoch(s, centre, [None], f"(1e0 / (1e0 + {r}))", kappa, centre, lam)
        a = f"(select a from {s.vector(f'{alpha} as a', '')})"
        later = s.vector(f"({lam} - {a} * {a} * {r} + sqrt(power({a} * {a} * {r} - {lam}, 2) + 4e0 * {r} * {r} * {a} * {a})) / (2e0 * {r}) as a", "")
        alpha = f"(select a from {later})"
        beta = f"(select b from {s.vector(f'({a} * (1e0 - {a}) * {r} / ({a} * {a} * {r} + {alpha} * {r})) as b', '')})"
        centre, before = s.combine([(f"1e0 + {beta}", mean), (f"-{beta}", before)]), mean
    return f"select *, true as refused from ({s.finish(mean)})"


RUNS = """classes as (select source, count(*) as n from documents group by source),
runs as (
  select source, n, algorithm, l2reg, seed
  from classes, (select unnest(['sgd', 'sgd_const', 'csvrg', 'csvrg_lr', 'svrg', 'pegasos', 'bcfw']) as algorithm) a,
    (select unnest([1e0, 1e-1, 1e-2]) as l2reg) b, (select unnest([0, 1, 2]) as seed) c)"""


class _RunSteps(_Steps):
    """The same for many runs at once: a vector has a row per ``run`` and ``p`` has the parameters of its run."""

    def __init__(self, buckets: int, group: str):
        super().__init__(buckets)
        self.group = group
        positive = "1e0 / (1e0 + exp(-abs({z})))"
        self.residual = f"(case when ({{z}}) >= 0e0 then {positive} else 1e0 - {positive} end - y)"

    def gradient(self, w: str, bucket: int | None, squared: bool = False) -> str:
        residual = self.residual.format(z="(" + " + ".join(f"x{j} * w.v{j}" for j in range(4)) + ")")
        chosen = "" if bucket is None else f" where bucket = {bucket}"
        return self.vector("w.run, " + ", ".join(f"avg({residual} * x{j}) as v{j}" for j in range(4)), f"from ex, {w} w{chosen} group by w.run")

    def combine(self, terms: list[tuple[str, str]]) -> str:
        columns = ", ".join(" + ".join(f"({c}) * {v}.v{j}" for c, v in terms) + f" as v{j}" for j in range(4))
        joined = " ".join(f"join {v} using (run)" for v in dict.fromkeys(v for _, v in terms))
        return self.vector(f"run, {columns}", f"from {self.group} p {joined}")

    def zero(self) -> str:
        return self.vector("run, 0e0 as v0, 0e0 as v1, 0e0 as v2, 0e0 as v3", f"from {self.group}")

    def objectives(self, w: str) -> str:
        z = "(" + " + ".join(f"x{j} * w.v{j}" for j in range(4)) + ")"
        square = " + ".join(f"any_value(w.v{j}) * any_value(w.v{j})" for j in range(4))
        loss = f"avg(greatest({z}, 0e0) + ln(1e0 + exp(-abs({z}))) - y * {z})"
        return f"select run, {loss} + any_value(p.lam) / 2e0 * ({square}) as v from ex, {w} w join {self.group} p using (run) group by run"


def _sweep() -> str:
    """Two passes of four minibatches of every run of the run table; the objective of its last model."""
    s = _RunSteps(4, "")
    s.parts[0:0] = [RUNS, """params as materialized (select *, l2reg / n as lam, row_number() over (order by source, algorithm, l2reg, seed) as run,
  32e0 / ((select count(*) from documents d join labels l on d.doc_id = l.doc_id) + 1e0) as wanted from runs)"""]  # fmt: skip
    rows = []

    def start(name: str) -> str:
        s.group = f"p_{name}"
        s.parts.append(f"p_{name} as materialized (select *, case when wanted > lam then wanted - lam else wanted end as kappa from params where algorithm = '{name}')")
        return s.zero()

    for name, rate in (("sgd", "(0.02e0 / (1e0 + {t} / 150000e0))"), ("sgd_const", "0.02e0"), ("pegasos", "(1e0 / (p.lam * ({t} + 1e0)))")):
        w = mean = start(name)
        for t, bucket in enumerate([*FOUR[0], *FOUR[1]]):
            step = rate.format(t=t)
            w = s.combine([(f"1e0 - {step} * p.lam", w), (f"-{step}", s.gradient(w, bucket))])
            mean = s.combine([(f"{t}e0 / {t + 2}e0", mean), (f"2e0 / {t + 2}e0", w)])
        rows.append(s.objectives(mean))
    w = start("svrg")
    for order in FOUR[:2]:
        w = _reduced_epoch(s, w, order, "0.02e0", "0e0", w, "p.lam")
    rows.append(s.objectives(w))
    for name, rate, kappa in (("csvrg", "(1e0 / (32e0 + p.lam + p.kappa))", "p.kappa"), ("csvrg_lr", "0.02e0", "p.lam")):
        zero = start(name)
        mean = _reduced_epoch(s, zero, FOUR[0], rate, kappa, zero, "p.lam")
        r, a = f"(p.lam + {kappa})", f"sqrt(p.lam / (p.lam + {kappa}))"
        later = f"((p.lam - {a} * {a} * {r} + sqrt(power({a} * {a} * {r} - p.lam, 2) + 4e0 * {r} * {r} * {a} * {a})) / (2e0 * {r}))"
        centre = s.combine([(f"1e0 + {a} * (1e0 - {a}) * {r} / ({a} * {a} * {r} + {later} * {r})", mean)])
        again = mean if name == "csvrg" else s.combine([("1e0", mean), (f"{kappa} / {r}", centre)])
        mean = _reduced_epoch(s, again, FOUR[1], rate, kappa, centre, "p.lam")
        rows.append(s.objectives(mean))
    found = " union all ".join(rows)
    return _ctes(*s.parts) + f"select source, algorithm, l2reg, seed, round(v, 9) + 0e0 as objective from ({found}) join params using (run)"


def _bcfw() -> str:
    """Two passes of two rounds. ``n`` is the number of groups; blocks of a bucket are a CTE of their own."""
    lam = "0.1e0"
    parts = [
        CANDS.replace("cands as (", "cands as materialized (").replace("golds as (", "golds as materialized ("),
        "num as materialized (select count(*) * 1e0 as n from golds)",
        f"bucketed as materialized (select *, ({_mix('group_id', 0)}) % 2 as bucket from cands)",
        "w0 as materialized (select 0e0 as v0, 0e0 as v1, 0e0 as v2, 0e0 as v3)",
        "m0 as materialized (select 0e0 as v0, 0e0 as v1, 0e0 as v2, 0e0 as v3)",
    ]
    blocks: dict[int, str] = {}
    four = range(4)
    for t, bucket in enumerate([0, 1, 1, 0]):
        z = " + ".join(f"c.x{j} * w.v{j}" for j in four)
        parts.append(f"""pick{t} as materialized (select * from (
  select c.*, row_number() over (partition by group_id order by ({z}) + (1e0 - iou) desc, cand) as p
  from bucketed c, w{t} w where bucket = {bucket}) where p = 1)""")
        corner = ", ".join(f"(g.x{j} - k.x{j}) / ({lam} * n) as s{j}" for j in four)
        old = "0e0 as b0, 0e0 as b1, 0e0 as b2, 0e0 as b3, 0e0 as bl"
        join = ""
        if bucket in blocks:
            old = ", ".join(f"o.b{j}" for j in four) + ", o.bl"
            join = f" join {blocks[bucket]} o on o.group_id = k.group_id"
        parts.append(f"""pair{t} as materialized (
  select k.group_id, {corner}, (1e0 - k.iou) / n as sl, {old}
  from pick{t} k join golds g on g.group_id = k.group_id{join}, num)""")
        sums = ", ".join(f"sum(b{j} - s{j}) as d{j}" for j in four)
        parts.append(f"dir{t} as materialized (select {sums}, sum(bl - sl) as dl from pair{t})")
        inner = " + ".join(f"v{j} * d{j}" for j in four)
        square = " + ".join(f"d{j} * d{j}" for j in four)
        parts.append(f"""gam{t} as materialized (
  select least(1e0, greatest(0e0, ({lam} * ({inner}) - dl) / ({lam} * ({square})))) as g from dir{t}, w{t})""")
        moved = ", ".join(f"v{j} - g * d{j} as v{j}" for j in four)
        parts.append(f"w{t + 1} as materialized (select {moved} from w{t}, dir{t}, gam{t})")
        blended = ", ".join(f"(1e0 - g) * b{j} + g * s{j} as b{j}" for j in four)
        parts.append(
            f"blk{t} as materialized (select group_id, {blended}, (1e0 - g) * bl + g * sl as bl from pair{t}, gam{t})"
        )
        blocks[bucket] = f"blk{t}"
        mean = ", ".join(f"({t}e0 * m{t}.v{j} + 2e0 * w{t + 1}.v{j}) / {t + 2}e0 as v{j}" for j in four)
        parts.append(f"m{t + 1} as materialized (select {mean} from m{t}, w{t + 1})")
    rows = " union all ".join(f"select {j} as idx, round(v{j}, 9) + 0e0 as w from m4" for j in four)
    return _ctes(*parts) + rows


TRAINING = {
    "sample_draws": _ctes(
        SMALL,
        f"shuffled as (select id, row_number() over (order by {_mix('id', 1)}, id) - 1 as r, count(*) over () as n from small)",
        f"draws as (select ({_mix('r', 5)}) % n as drawn, count(*) as c from shuffled group by 1)",
    )
    + "select id, coalesce(c, 0) as n_draws from shuffled left join draws on drawn = r",
    "sgd_steps": _sgd(),
    "svrg_steps": _svrg(),
    "accelerated_svrg_steps": _accelerated(),
    "bcfw_steps": _bcfw(),
    "model_sink": f"select *, 3 as n_logged from ({_svrg()})",
    "own_loss_steps": _own_loss(),
    "own_smoothed_steps": _own_smoothed(),
    "train_log": _train_log(),
    "sweep": _sweep(),
}

# Runs -----------------------------------------------------------------------------------------------

RUN_TABLES = {
    "run_grid": _ctes(RUNS)
    + "select source, algorithm, l2reg, seed, n, round(l2reg / n, 12) as penalty from runs",
    "run_key": _ctes(RUNS)
    + """select source, case algorithm
  when 'sgd' then 'sgd_' || l2reg || '_0.02_150000.0__' || seed
  when 'sgd_const' then 'sgd_const_' || l2reg || '_0.02__' || seed
  when 'svrg' then 'svrg_const_' || l2reg || '_0.02__' || seed || '_2.0_5'
  when 'csvrg' then 'csvrg_const_' || l2reg || '_32.0__' || seed || '_2.0_5_option3'
  when 'csvrg_lr' then 'csvrg_lr_expo_' || l2reg || '_0.02__' || seed || '_2.0_5_option2'
  else algorithm || '_' || l2reg || '_32.0__' || seed end as run_id
from runs""",
}

ORACLES: dict[str, str] = {**CORPUS, **CANDIDATES, **BINARY, **SEQUENCES, **TRAINING, **RUN_TABLES}
