"""Registered queries over the engine's operators, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import fixed
from .functions import text as T
from .operators import dialogue, metrics, pairs, vectors
from .sources import stages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table. Documents of up to 64 MB, which may be one row group, are dealt over all cores; larger ones are read as they are."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name == "documents":
        store, at = stages.hadoop_path(spark, path)
        if store.getContentSummary(at).getLength() <= 64 << 20:
            return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def turns(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text")


def timed(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("speaker"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL fragments of the oracles ---
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
CONTRACTED = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in fixed.CONTRACTIONS.items()) + "}"


def sql_clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    for pattern, new, flags in ((fixed.URL, " __url__ ", "gi"), (fixed.PATH, " __path__ ", "g"), (fixed.IPV4, " __ip__ ", "g"), (fixed.NICK, "", "g")):
        t = f"regexp_replace({t}, {quoted(pattern)}, '{new}', '{flags}')"
    t = f"regexp_replace(lower({t}), {quoted(fixed.ADDRESS)}, '')"
    t = f"coalesce(array_to_string(list_transform({WORDS(t)}, lambda w: coalesce({CONTRACTED}[w], w)), ' '), '')"
    for pattern, new in fixed.CLEANUP:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return f"coalesce(array_to_string(list_filter(list_transform({WORDS(t)}, lambda w: ltrim(w, '''')), lambda w: w <> ''), ' '), '')"


COUNTED = lambda x, c: f"(length({x}) - length(regexp_replace({x}, '{c}', '', 'g')))"
SHAPE = """with m as (select conv_id id, role, case when lag(role) over (partition by conv_id order by turn) <> role then 1
    when lag(role) over (partition by conv_id order by turn) = role then 0 end changed, count(*) over (partition by conv_id, role) of_speaker from conversations),
    s as (select id, count(*) n, count(distinct role) n_speakers, max(of_speaker) / count(*) dominance,
    coalesce(sum(changed) / nullif(count(*) - 1, 0), 0) alternation from m group by id),
    r as (select *, case when n < 2 then 'too_few_turns' when n_speakers <> 2 then 'not_dyadic' when dominance > 0.8 then 'speaker_dominance'
    when alternation < 0.15 then 'low_alternation' else 'kept' end reason from s) """
FRAMED = """with f as (select conv_id id, row_number() over w - 1 pos, array_to_string(list(text) over (partition by conv_id order by turn rows between 8 preceding and 1 preceding), ' __eot__ ') ctx,
    text resp from conversations window w as (partition by conv_id order by turn)), p as (select * from f where pos >= 1) """
ENGLISH = lambda x: f"({COUNTED(x, chr(92) + 'p{L}')} < 3 or {COUNTED(x, '[A-Za-z]')} / {COUNTED(x, chr(92) + 'p{L}')} >= 0.8)"


@query("select conv_id id, count(*) n_turns, count(distinct role) n_speakers, string_agg(role, '|' order by turn) roles, md5(string_agg(text, '|' order by turn)) text_md5 from conversations group by conv_id")
def dialogue_group(spark, sf_dir):
    df = dialogue.grouped(turns(spark, sf_dir))
    join = lambda f: F.array_join(F.transform("turns", lambda x: x[f]), "|")
    return df.select("id", "n_turns", "n_speakers", join("speaker").alias("roles"), F.md5(join("text")).alias("text_md5"))


@query(SHAPE + "select reason, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 2) pct from r group by reason")
def dialogue_filter_reasons(spark, sf_dir):
    df = dialogue.shape(turns(spark, sf_dir)).withColumn("reason", dialogue.reason()).groupBy("reason").agg(F.count("*").alias("n"))
    return df.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query(f"select doc_id, md5({sql_clean('text')}) clean_md5 from documents")
def document_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5"))


@query(f"select conv_id, turn, {sql_clean('text')} clean from conversations")
def turn_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean(F.col("text")).alias("clean"))


@query(f"""select doc_id, length(text) >= 10 and ({COUNTED('text', chr(92) + 'p{L}')} / length(text) < 0.30
    or (length(text) - length(translate(text, {quoted(fixed.PASTE_SPECIAL)}, ''))) / length(text) > 0.15 or (length(text) - length(replace(text, ':', '')) >= 3 and length(text) < 200)) is_paste,
    coalesce((select count(*) >= 4 and max(c) / sum(c) > 0.5 and sum(c) >= 4 from (select w, count(*) c from (select unnest({WORDS('lower(text)')}) w) group by w)), false) is_repetitive from documents""".replace("count(*) >= 4 and ", ""))
def paste_repetitive_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_paste(F.col("text")).alias("is_paste"), T.is_repetitive(F.col("text")).alias("is_repetitive"))


@query(f"select lang, count(*) n, count(case when {ENGLISH('text')} then 1 end) n_english, round(avg({COUNTED('text', '[A-Za-z]')} / nullif({COUNTED('text', chr(92) + 'p{L}')}, 0)), 6) ratio from documents group by lang")
def english_ratio(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_english(c)).alias("n_english"), F.round(F.avg(T.ascii_ratio(c)), 6).alias("ratio"))


@query("""with g as (select user_id id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) / 1e6 gap from events),
    a as (select id, count(*) n, max(gap) max_gap, avg(case when gap > 43200 then 1.0 when gap is not null then 0.0 end) soft_ratio from g group by id)
    select id, n, round(max_gap, 3) max_gap, round(soft_ratio, 6) soft_ratio, case when n < 2 then 'too_few_valid_dates' when max_gap > 172800 then 'temporal_hard_ceiling' when soft_ratio > 0.3 then 'temporal_gap_ratio' else 'kept' end reason from a""")
def temporal_gaps(spark, sf_dir):
    return dialogue.gaps(timed(spark, sf_dir), hard=172_800, soft=43_200).withColumns({"max_gap": F.round("max_gap", 3), "soft_ratio": F.round("soft_ratio", 6)})


@query("""with g as (select user_id id, ts, case when date_diff('microsecond', lag(ts) over w, ts) // 1000000 <= 43200 then 0 else 1 end new from events window w as (partition by user_id order by ts)),
    s as (select id, ts, sum(new) over (partition by id order by ts) session from g) select id, cast(session as bigint) session, count(*) n, min(ts) first_ts from s group by id, session""")
def session_split(spark, sf_dir):
    return dialogue.sessions(timed(spark, sf_dir), 43_200).groupBy("id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("""with i as (select user_id id, event_id, event_type, case when lower(event_type) = lag(lower(event_type)) over (partition by user_id order by event_id) then 0 else 1 end new from events),
    s as (select *, sum(new) over (partition by id order by event_id) island from i) select id, cast(island as bigint) island, min(event_id) first_event, count(*) n, max(event_type) kind from s group by id, island""")
def same_actor_merge(spark, sf_dir):
    df = dialogue.islands(timed(spark, sf_dir))
    return df.groupBy("id", "island").agg(F.min("ord").alias("first_event"), F.count("*").alias("n"), F.max("speaker").alias("kind"))


SPLIT = """with f as (select user_id id, min(ts) first_ts from events group by 1), s as (select id, case when first_ts < timestamp '2024-01-02' then 'train' when first_ts < timestamp '2024-01-03' then 'val' else 'test' end split from f) """


@query(SPLIT + "select split, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 1) pct from s group by split")
def temporal_split_counts(spark, sf_dir):
    df = dialogue.split_by_first(timed(spark, sf_dir), "2024-01-02", "2024-01-03").groupBy("split").agg(F.count("*").alias("n"))
    return df.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


@query(SPLIT + ", o as (select id, list(distinct split) l from s group by id) select unnest(['train_val','train_test','val_test']) pair, unnest([(select count(*) from o where list_contains(l,'train') and list_contains(l,'val')),(select count(*) from o where list_contains(l,'train') and list_contains(l,'test')),(select count(*) from o where list_contains(l,'val') and list_contains(l,'test'))]) overlap")
def split_leakage(spark, sf_dir):
    return dialogue.leakage(dialogue.split_by_first(timed(spark, sf_dir), "2024-01-02", "2024-01-03"))


@query(FRAMED + "select id, pos, md5(ctx) ctx_md5, length(ctx) ctx_chars, resp from p")
def context_windows(spark, sf_dir):
    return pairs.framed(turns(spark, sf_dir)).select("id", "pos", F.md5("ctx").alias("ctx_md5"), F.length("ctx").cast("long").alias("ctx_chars"), "resp")


CLEAN_FRAMED = FRAMED.replace("list(text) over", "list(t) over").replace("text resp from conversations", "t resp from c").replace("with f as", f"with c as (select conv_id, turn, {sql_clean('text')} t from conversations), f as")
NW = lambda x: f"len({WORDS(x)})"
STOP = "[" + ", ".join(map(quoted, fixed.STOPWORDS)) + "]"
CONTENT = lambda x: f"list_distinct(list_filter({WORDS(x)}, lambda y: regexp_full_match(y, '[a-z]{{4,}}') and not list_contains({STOP}, y)))"
INCOHERENT = f"""coalesce(len({CONTENT('resp')}) >= 5 and not list_has_any(list_filter(list_transform(list_reverse(string_split(ctx, ' __eot__ ')), lambda z: {CONTENT('z')}), lambda u: len(u) >= 5)[1], {CONTENT('resp')}), false)"""
ECHO = "(length(resp) >= 6 and contains(lower(trim(regexp_replace(regexp_replace(ctx, '__eot__|__user__', ' ', 'g'), '\\s{2,}', ' ', 'g'))), lower(resp)))"
BOT = "(" + " or ".join(f"starts_with(resp, {quoted(p)})" for p in fixed.BOT_PREFIXES) + ")"
REASON = f"""case when {NW('ctx')} < 3 then 'ctx_too_short' when {NW('resp')} < 5 then 'resp_too_short' when {NW('resp')} > 300 then 'resp_too_long' when not {ENGLISH('resp')} then 'non_english'
    when {BOT} then 'bot_response' when {ECHO} then 'echo_pair' when regexp_matches(resp, {quoted(fixed.PLACEHOLDERS)}) then 'placeholder_only' when {INCOHERENT} then 'incoherent_pair' else 'kept' end"""


def clean_pairs(spark, sf_dir):
    return pairs.framed(turns(spark, sf_dir).withColumn("text", T.clean(F.col("text"))))


@query(CLEAN_FRAMED + f"select id, pos, {REASON} reason, md5(ctx) ctx_md5, md5(resp) resp_md5 from p")
def pair_generation(spark, sf_dir):
    return clean_pairs(spark, sf_dir).select("id", "pos", pairs.discard_reason(max_resp=300).alias("reason"), F.md5("ctx").alias("ctx_md5"), F.md5("resp").alias("resp_md5"))


@query(CLEAN_FRAMED + f"select reason, count(*) n from (select {REASON} reason from p) group by reason")
def pair_discard_counts(spark, sf_dir):
    return clean_pairs(spark, sf_dir).groupBy(pairs.discard_reason(max_resp=300).alias("reason")).agg(F.count("*").alias("n"))


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by text order by doc_id) r from documents) where r <= 2")
def response_diversity_cap(spark, sf_dir):
    return pairs.capped(table(spark, sf_dir, "documents"), cap=2, resp="text", order=("doc_id",)).select("doc_id", "source")


CMD = lambda x: f"(regexp_matches({x}, '(?i)\\b({'|'.join(fixed.COMMANDS)})\\b') or contains({x}, '__path__'))"
Q = f"""regexp_matches(coalesce(list_filter(list_reverse(string_split(ctx, ' __eot__ ')[-3:]), lambda z: {NW('z')} >= 4)[1], string_split(ctx, ' __eot__ ')[-1]), {quoted('|'.join(fixed.QUESTIONS.values()))})"""


def domain_query(strategy: str, condition: str):
    def run(spark, sf_dir):
        return clean_pairs(spark, sf_dir).filter(pairs.domain(strategy, F.col("ctx"), F.col("resp"))).select("id", "pos")

    run.__name__ = f"domain_filter_{strategy}"
    return query(CLEAN_FRAMED + f"select id, pos from p where {condition}")(run)


for _strategy, _condition in (("command", f"{CMD('ctx')} or {CMD('resp')}"), ("question", Q), ("union", f"{CMD('ctx')} or {CMD('resp')} or {Q}"), ("intersection", f"({CMD('ctx')} or {CMD('resp')}) and {Q}")):
    domain_query(_strategy, _condition)


@query(CLEAN_FRAMED + f"select count(*) total, count(case when c or q then 1 end) kept, count(case when c then 1 end) n_cmd, count(case when q then 1 end) n_question, count(case when c and q then 1 end) n_both, 'all' as split from (select {CMD('ctx')} or {CMD('resp')} c, {Q} q from p)")
def domain_stats(spark, sf_dir):
    return pairs.domain_stats(clean_pairs(spark, sf_dir).withColumn("split", F.lit("all")))


@query("select pattern, n from (select " + ", ".join(f"count(case when regexp_matches(text, {quoted(p)}) then 1 end) {k}" for k, p in fixed.QUESTIONS.items()) + " from documents) unpivot (n for pattern in (" + ", ".join(fixed.QUESTIONS) + "))")
def question_signals(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select(T.ascii_only(F.col("text")).alias("text"))
    df = asked.agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in fixed.QUESTIONS.items()])
    return df.unpivot([], list(fixed.QUESTIONS), "pattern", "n")


def lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text", T.n_words(F.col("text")).alias("n"))


@query(f"select round(avg(n), 1) mean, " + ", ".join(f"cast(floor(quantile_cont(n, {p / 100})) as bigint) p{p}" for p in (50, 75, 90, 95, 99)) + f" from (select {NW('text')} n from documents)")
def length_percentiles(spark, sf_dir):
    return metrics.length_percentiles(lengths(spark, sf_dir), "n")


@query(f"select bucket, coalesce(n, 0) n from (select unnest(['0','1-5','6-10','11-20','21+']) bucket) left join (select case when n = 0 then '0' when n <= 5 then '1-5' when n <= 10 then '6-10' when n <= 20 then '11-20' else '21+' end bucket, count(*) n from (select {NW('text')} n from documents) group by 1) using (bucket)")
def length_histogram(spark, sf_dir):
    return metrics.length_histogram(lengths(spark, sf_dir), "n")


@query(f"select n upper_median from (select {NW('text')} n from documents) order by n limit 1 offset (select count(*) // 2 from documents)")
def upper_median_length(spark, sf_dir):
    return metrics.upper_median(lengths(spark, sf_dir), "n")


@query("select md5(text) text_md5, n, first_seen from (select text, count(*) n, min(doc_id) first_seen from documents group by text order by n desc, first_seen limit 20)")
def top_responses(spark, sf_dir):
    return metrics.top_responses(table(spark, sf_dir, "documents"), "text", "doc_id").select(F.md5("text").alias("text_md5"), "n", "first_seen")


@query("select count(*) n_unique, cast(sum(n) as bigint) n_total, round(count(*) / sum(n), 4) ratio, count(case when n > 100 then 1 end) over_100, count(case when n > 500 then 1 end) over_500, max(n) top from (select count(*) n from documents group by text)")
def diversity_ratio(spark, sf_dir):
    return metrics.diversity(table(spark, sf_dir, "documents"), "text")


@query("select doc_id, source from documents order by md5(concat_ws(':', cast(doc_id as varchar), '42')) limit 100")
def sample_md5(spark, sf_dir):
    return pairs.sampled(table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id", "source")


def spoken(spark, sf_dir):
    """Each assistant turn with the turn before it: hyp and ref as words."""
    inside = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(inside)).filter("role = 'assistant' and before is not null")
    return df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), T.tokens(F.col("text")).alias("hyp"), T.tokens(F.col("before")).alias("ref"))


SPOKEN = f"""with b as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) before from conversations),
    s as (select conv_id * 1000 + turn sample_id, {WORDS('text')} hyp, {WORDS('before')} ref from b where role = 'assistant' and before is not null) """
GRAMS = lambda c, n: f"(select sample_id, g, count(*) c from (select sample_id, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n} - 1], chr(31)))) g from s where len({c}) >= {n}) group by all)"
CLIP = lambda n: f"(select {n} n, coalesce(sum(least(h.c, coalesce(r.c, 0))), 0) matched, coalesce(sum(h.c), 0) total from {GRAMS('hyp', n)} h left join {GRAMS('ref', n)} r using (sample_id, g))"


@query(SPOKEN + "select cast(n as bigint) n, cast(matched as bigint) matched, cast(total as bigint) total, round(coalesce(matched / nullif(total, 0), 0), 6) as \"precision\" from (" + " union all ".join(f"select * from {CLIP(n)}" for n in (1, 2, 3, 4)) + ")")
def clipped_precision_n(spark, sf_dir):
    return metrics.clipped(spoken(spark, sf_dir)).withColumn("precision", F.round("precision", 6))


@query(SPOKEN + ", p as (" + " union all ".join(f"select n, greatest(coalesce(matched / nullif(total, 0), 0), 1e-9) p, coalesce(matched / nullif(total, 0), 0) raw from {CLIP(n)}" for n in (1, 2, 3, 4)) + """),
    z as (select case when sum(len(hyp)) >= sum(len(ref)) then 1.0 else exp(1 - sum(len(ref)) / greatest(sum(len(hyp)), 1)) end bp from s)
    select round(bp * (select raw from p where n = 1), 6) bleu1, round(bp * exp((select avg(ln(p)) from p where n <= 2)), 6) bleu2, round(bp * exp((select avg(ln(p)) from p)), 6) bleu4 from z""")
def bleu_mini(spark, sf_dir):
    df = metrics.bleu(spoken(spark, sf_dir))
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(SPOKEN + f", h as {GRAMS('hyp', 2)}, r as {GRAMS('ref', 2)}, m as (select sample_id, sum(least(h.c, coalesce(r.c, 0))) / sum(h.c) v from h left join r using (sample_id, g) group by sample_id) select sample_id, round(coalesce(v, 0), 6) bleu2 from s left join m using (sample_id)")
def bleu_vs_input(spark, sf_dir):
    return metrics.bleu_in_row(spoken(spark, sf_dir), 2).select("sample_id", F.round("bleu", 6).alias("bleu2"))


@query(f"with s as (select doc_id sample_id, {WORDS('text')} hyp from documents), g as {GRAMS('hyp', 2)} select count(distinct g) n_unique, cast(sum(c) as bigint) n_total, round(count(distinct g) / greatest(sum(c), 1), 6) ratio from g")
def distinct_n(spark, sf_dir):
    df = metrics.distinct_n(table(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("w")), "w", 2)
    return df.withColumn("ratio", F.round("ratio", 6))


@query()
def rouge_l(spark, sf_dir):
    return metrics.rouge_l(spoken(spark, sf_dir))


@query("with n as (select sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) n from embeddings) select count(*) n_rows, count(case when n <= 1e-6 then 1 end) n_zero, round(avg(n) filter (n > 1e-6), 6) mean, round(stddev_pop(n) filter (n > 1e-6), 6) std, round(min(n) filter (n > 1e-6), 6) min, round(max(n) filter (n > 1e-6), 6) max, round(count(case when n > 1e-6 then 1 end) / count(*), 6) coverage from n")
def vector_norm_stats(spark, sf_dir):
    return vectors.norm_stats(table(spark, sf_dir, "embeddings"), "embedding")


@query("select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 0) as double[])), 6) cosine from embeddings order by cosine desc, vec_id limit 6")
def cosine_topk(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    first = df.filter("vec_id = 0").first()
    return vectors.nearest(df, first["embedding"], "vec_id", "embedding", 6)


@query("""with m as (select label, i, avg(cast(embedding[i] as double)) m from embeddings, (select unnest(range(1, 65)) i) group by label, i), c as (select label, list(m order by i) c from m group by label)
    select a.label label_a, b.label label_b, round(list_cosine_similarity(a.c, b.c), 5) cosine from c a join c b on a.label < b.label""")
def label_pair_cosine(spark, sf_dir):
    c = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    a, b = c.select(F.col("label").alias("label_a"), F.col("centroid").alias("a")), c.select(F.col("label").alias("label_b"), F.col("centroid").alias("b"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", F.round(A.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


@query("select count(*) n_distinct, cast(sum(c) as bigint) n_rows from (select count(*) c from embeddings group by list_transform(embedding, lambda x: round(cast(x as double), 3)))")
def near_duplicate_vectors(spark, sf_dir):
    return vectors.rounded_duplicates(table(spark, sf_dir, "embeddings"), "embedding")


@query("select 0 n_nan, 0 n_inf, cast(sum(len(embedding)) as bigint) n_values from embeddings".replace("select 0 n_nan, 0 n_inf", "select cast(sum(len(list_filter(embedding, lambda x: isnan(x)))) as bigint) n_nan, cast(sum(len(list_filter(embedding, lambda x: isinf(x)))) as bigint) n_inf"))
def non_finite_values(spark, sf_dir):
    return vectors.non_finite(table(spark, sf_dir, "embeddings"), "embedding")


@query("with c as (select count(*) t, count(case when len(embedding) <> 64 then 1 end) s, sum(len(list_filter(embedding, lambda x: isnan(x)))) f, avg(case when list_sum(list_transform(embedding, lambda x: x * x)) > 1e-12 then 1.0 else 0.0 end) v from embeddings) select 'A' as section, unnest(['shape','finite','coverage']) as name, unnest([case when s = 0 then 'PASS' else 'FAIL' end, case when f = 0 then 'PASS' else 'FAIL' end, case when v >= 0.999 then 'PASS' else 'FAIL' end]) status from c")
def embedding_audit(spark, sf_dir):
    return vectors.audit(table(spark, sf_dir, "embeddings"), "embedding", 64)


@query("select source, count(*) n_docs, count(quality) n_labelled, round(count(quality) / count(*), 6) coverage from documents left join labels using (doc_id) group by source")
def coverage_join(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source")
    return df.agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"))


@query("select event_id, case when e <= 5 then 1.0 when e <= 12 then round(0.9 - (e - 6) * 0.4 / 6, 6) else 0.5 end tf from (select event_id, event_id % 20 + 1 e from events)")
def tf_schedule(spark, sf_dir):
    """The share of teacher forcing in each event's epoch."""
    epoch = (F.col("event_id") % 20 + 1).alias("e")
    return table(spark, sf_dir, "events").select("event_id", F.round(A.teacher_forcing(epoch), 6).alias("tf"))


@query("select event_id, round(case when s < 50 then s / 50 else 0.5 * (1 + cos(pi() * least(1.0, (s - 50) / 450))) end, 6) lr from (select event_id, event_id % 600 s from events)")
def lr_schedule(spark, sf_dir):
    """The learning rate at each event's step."""
    return table(spark, sf_dir, "events").select("event_id", F.round(A.warmup_cosine(F.col("event_id") % 600, 50, 500), 6).alias("lr"))


@query("select o_orderpriority, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 4) pct from orders group by 1")
def percent_of_total(spark, sf_dir):
    df = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return df.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("select lang, doc_id, n_chars, r from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) r from documents) where r <= 5")
def rank_by_group(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    return table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", r.alias("r")).filter("r <= 5")


@query("select coalesce(source, 'ALL') source, coalesce(lang, 'ALL') lang, count(*) n, cast(sum(n_chars) as bigint) chars from documents group by rollup (source, lang)")
def rollup_split_stats(spark, sf_dir):
    df = table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return df.select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("lang", F.lit("ALL")).alias("lang"), "n", "chars")


@query(f"select conv_id id, turn ord, md5(coalesce(array_to_string(list_filter(list(t) over (partition by conv_id order by turn rows between 7 preceding and current row), lambda x: x <> ''), ' __eot__ '), '')) history_md5 from (select conv_id, turn, {sql_clean('text')} t from conversations)")
def history_window(spark, sf_dir):
    return pairs.history(turns(spark, sf_dir)).select("id", "ord", F.md5("history").alias("history_md5"))


@query("select doc_id, lower(trim(text)) in (" + ", ".join(map(quoted, fixed.GENERIC)) + f") is_generic, lower(trim(text)) in (" + ", ".join(map(quoted, fixed.TRIVIAL)) + f") is_trivial, {NW('text')} < 2 is_short, regexp_matches(text, {quoted(fixed.IPV4)}) has_ip from documents")
def response_flags(spark, sf_dir):
    t = F.lower(F.trim("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.isin(*fixed.GENERIC).alias("is_generic"), t.isin(*fixed.TRIVIAL).alias("is_trivial"), (T.n_words(F.col("text")) < 2).alias("is_short"), F.col("text").rlike(fixed.IPV4).alias("has_ip"))


@query("select quality, toxic, count(*) n, case when avg(n_chars) < 500 then 'COLLAPSE' else 'OK' end verdict from labels join documents using (doc_id) group by quality, toxic")
def label_verdict(spark, sf_dir):
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("c"))
    none = F.lit(None).cast("double")
    return df.select("quality", "toxic", "n", metrics.verdict(none, none, none, F.when(F.col("c") < 500, 1.0), none, F.lit(16000)).alias("verdict"))


@query("select item_id, count(doc_id) n_docs from benchmark left join documents on contains(documents.text, benchmark.text) group by item_id")
def benchmark_contamination(spark, sf_dir):
    """Documents that hold an item's whole text. An item's words but its first and last are whole words of such a document: they meet by
    up to `k` of these, then the whole is compared. Items of fewer than three words have none and are compared with every document."""
    k = 5
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), T.tokens(F.col("text")).alias("i"))
    items = items.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(k), F.size("i") - 2)))
    items = items.withColumn("head", F.concat_ws(" ", F.col("k").cast("string"), F.array_join(F.slice("i", 2, F.col("k")), " ")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", F.lit(str(n)), F.array_join(F.slice("w", i, n), " ")))).otherwise(F.array().cast("array<string>"))
    sizes = [r["k"] for r in items.filter("k > 0").select("k").distinct().collect()]  # k at most
    whole = F.col("text").contains(F.col("item"))
    hits = docs.join(items.filter("k = 0").select("item_id", "item"), whole).select("item_id", "doc_id")
    if sizes:
        heads = docs.select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*map(grams, sorted(sizes))))).alias("head"))
        wanted = heads.join(items.select("item_id", "head"), "head").select("doc_id", "item_id").distinct()
        hits = hits.unionByName(wanted.join(docs, "doc_id").join(items.select("item_id", "item"), "item_id").filter(whole).select("item_id", "doc_id"))
    hits = hits.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


# --- operators that SQL can't express ---


def vocabulary(spark, sf_dir):
    from .operators import bpe

    return bpe.learn(table(spark, sf_dir, "documents").select(T.clean(F.col("text")).alias("text")), "text")


@query()
def bpe_vocab(spark, sf_dir):
    model = vocabulary(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(model.pieces)), "id long, piece string")


@query()
def bpe_encode(spark, sf_dir):
    from .operators import bpe

    model = vocabulary(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))
    return bpe.encoded(rows, model, "text", "doc_id").select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids_md5"))


@query()
def word2vec_vectors(spark, sf_dir):
    """The vectors of the pieces of a vocabulary of the conversations, learned over their turns with the operators' defaults."""
    from .operators import bpe

    lines = table(spark, sf_dir, "conversations").select("conv_id", T.clean(F.col("text")).alias("text"))
    model = bpe.learn(lines, "text")
    pieces = spark.createDataFrame(list(enumerate(model.pieces)), "id int, piece string")
    ids = bpe.encoded(lines, model, "text", "conv_id").select(F.col("ids").cast("array<string>"))
    vec = bpe.word_vectors(ids, "ids").select(F.col("piece").cast("int").alias("id"), "vec")
    return pieces.join(vec, "id").select("piece", F.size("vec").alias("dim"), "vec")


def stage_rows(spark, sf_dir):
    return dialogue.shape(turns(spark, sf_dir)).groupBy(dialogue.reason().alias("metric")).agg(F.count("*").cast("double").alias("value"))


@query(SHAPE + "select 'filter' as stage, reason as metric, cast(count(*) as double) as value from r group by reason")
def stage_stats_long(spark, sf_dir):
    return stage_rows(spark, sf_dir).select(F.lit("filter").alias("stage"), "metric", "value")


@query("with s as (select e.user_id id, e.event_id, e.value, row_number() over (partition by user_id order by event_id) r from events e), p as (select *, min(value) over (partition by id order by r rows between unbounded preceding and 1 preceding) b from s), i as (select *, b is null or value < b improved from p) select id, r as epoch, improved, r - max(case when improved or r <= 5 then r end) over (partition by id order by r) as since from i")
def early_stopping(spark, sf_dir):
    from .operators import decoding

    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), epoch.alias("epoch"), F.col("value").alias("val_loss"))
    return decoding.early_stop(h).select(F.col("model").alias("id"), "epoch", "improved", "since")


@query("with e as (select vec_id, list_transform(embedding, lambda x: exp(cast(x as double) - list_max(embedding))) e from embeddings) select vec_id, round(list_max(e) / list_sum(e), 6) top_p, round(-list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e)))), 5) entropy from e")
def softmax_top(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    top = p.select("vec_id", F.transform("v", lambda x: F.exp(x - F.array_max("v"))).alias("e")).select("vec_id", "e", A.total(F.col("e")).alias("t"))
    return top.select("vec_id", F.round(F.array_max("e") / F.col("t"), 6).alias("top_p"), F.round(-F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x / F.col("t") * F.log(x / F.col("t"))), 5).alias("entropy"))


CONF = "(select vec_id, list_transform(embedding, lambda x: abs(cast(x as double))) c from embeddings)"


@query(f"select vec_id, round(exp(-list_avg(list_transform(c, lambda x: ln(greatest(x, 1e-10))))), 2) perplexity, len(list_filter(c, lambda x: x < 0.4)) low, len(list_filter(c, lambda x: x >= 0.4 and x < 0.6)) medium, len(list_filter(c, lambda x: x >= 0.6 and x < 0.8)) good, len(list_filter(c, lambda x: x >= 0.8)) high from {CONF}")
def confidence_analysis(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("c"))
    return c.select("vec_id", metrics.confidence(F.col("c")).alias("m")).select("vec_id", "m.*")


@query(CLEAN_FRAMED + f"select id, pos, {ECHO} is_echo, {BOT} is_bot, regexp_matches(resp, {quoted(fixed.PLACEHOLDERS)}) is_placeholder from p")
def echo_pairs(spark, sf_dir):
    ctx, resp = F.col("ctx"), F.col("resp")
    return clean_pairs(spark, sf_dir).select("id", "pos", T.is_echo(ctx, resp).alias("is_echo"), T.is_bot_response(resp).alias("is_bot"), T.is_placeholder_only(resp).alias("is_placeholder"))


@query(CLEAN_FRAMED + f"select id, pos, {INCOHERENT} incoherent, len({CONTENT('resp')}) n_content from p")
def coherence_filter(spark, sf_dir):
    df = clean_pairs(spark, sf_dir)
    return df.select("id", "pos", T.is_incoherent(F.col("ctx"), F.col("resp")).alias("incoherent"), F.size(T.content_words(F.col("resp"))).cast("long").alias("n_content"))


@query("select source, count(case when lang = 'en' then 1 end) en, count(case when lang = 'fr' then 1 end) fr, count(case when lang = 'de' then 1 end) de, count(case when lang = 'es' then 1 end) es from documents group by source")
def source_by_lang(spark, sf_dir):
    df = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))
    return df.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("en", "fr", "de", "es")])


@query("select metric, value from (select cast(count(*) as double) n_rows, cast(sum(n_chars) as double) n_chars, cast(max(n_chars) as double) longest from documents) unpivot (value for metric in (n_rows, n_chars, longest))")
def metrics_long(spark, sf_dir):
    from .sources import sinks

    row = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"), F.max("n_chars").alias("longest"))
    return sinks.long_metrics(row, "documents").drop("section")


@query("with v as (select item_id id, text piece from benchmark), m as (select v.id, v.piece, e.embedding from v left join embeddings e on v.id = e.vec_id) select id, case when id = 0 or embedding is null then 0.0 else round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) end norm from m")
def embedding_matrix(spark, sf_dir):
    vocab = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").cast("string").alias("piece"))
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("piece"), F.col("embedding").alias("vec"))
    return vectors.matrix(vocab, vec, 64).select("id", F.round(A.norm(F.col("vec")), 4).alias("norm"))


@query(f"select h.conv_id sample_id, coalesce(len({WORDS('h.text')}), 0) hyp_words, coalesce(len({WORDS('r.text')}), 0) ref_words from (select conv_id, text from conversations where turn = 1) h full outer join (select conv_id, text from conversations where turn = 2) r using (conv_id)".replace("h.conv_id sample_id", "coalesce(h.conv_id, r.conv_id) sample_id"))
def side_by_side(spark, sf_dir):
    at = lambda k, name: table(spark, sf_dir, "conversations").filter(F.col("turn") == k).select(F.col("conv_id").alias("sample_id"), T.n_words(F.col("text")).alias(name))
    df = at(1, "hyp_words").join(at(2, "ref_words"), "sample_id", "full_outer")
    return df.select("sample_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hyp_words", "ref_words")])
