"""Registered queries of the corpus plan, of files, audits, reports and decoding, each with its SQL equivalent.

Fixtures are made of the given tables by expressions that SQL can repeat: names, times, ids and broken lines depend on a row's
number, so that every rule and branch has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import CLEAN_FRAMED, CMD, ECHO, ORACLES, QUERIES, SPOKEN, STOP, WORDS, Q, REASON, NW, clean_pairs, query, quoted, sql_clean, spoken, table, turns, COUNTED  # noqa: F401
from .functions import arrays as A
from .functions import fixed
from .functions import text as T
from .operators import bpe, decoding, dialogue, metrics, pairs, vectors
from .plans import corpus
from .sources import sinks, stages
from .sources import turns as sources
from .streaming import history, sessions

# --- the corpus plan ---

NAMED = "select conv_id id, turn ord, role || '_' || (conv_id % 7) speaker, text || ' ' || role || '_' || (conv_id % 7) || ' and Ubottu''s help, xuser_1x' as text from conversations"
HIDE_BOTS = r"(?i)\b(?:" + "|".join(sorted(fixed.BOTS, key=len, reverse=True)) + r")(?:'s)?\b"
HIDDEN = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\b' || coalesce(names[1], '~') || '\\b', '__user__', 'g'), '\\b' || coalesce(names[2], '~') || '\\b', '__user__', 'g'), '\\b' || coalesce(names[3], '~') || '\\b', '__user__', 'g'), {quoted(HIDE_BOTS)}, '__user__', 'g')"


@query(f"""with t as ({NAMED}), n as (select id, list(distinct speaker) names from t group by id),
    f as (select id, row_number() over w - 1 pos, array_to_string(list(text) over (partition by id order by ord rows between 8 preceding and 1 preceding), ' __eot__ ') ctx, text resp from t window w as (partition by id order by ord))
    select id, pos, md5({HIDDEN('ctx')}) ctx_md5, md5({HIDDEN('resp')}) resp_md5, resp <> {HIDDEN('resp')} hidden from f join n using (id) where pos >= 1""")
def masked_pairs(spark, sf_dir):
    """Names of speakers (with a digit or sign, or long) and of bots are masked in contexts and responses."""
    df = turns(spark, sf_dir)
    name = F.concat("speaker", F.lit("_"), (F.col("id") % 7).cast("string"))
    df = df.withColumns({"speaker": name, "text": F.concat("text", F.lit(" "), name, F.lit(" and Ubottu's help, xuser_1x"))})
    plain = pairs.framed(df)
    both = pairs.masked(plain.withColumn("plain", F.col("resp")), df)
    return both.select("id", "pos", F.md5("ctx").alias("ctx_md5"), F.md5("resp").alias("resp_md5"), (F.col("plain") != F.col("resp")).alias("hidden"))


TALK = """select user_id * 4 + event_id % 4 id, event_id ord, row_number() over w r, count(*) over (partition by user_id * 4 + event_id % 4) n,
    (user_id * 4 + event_id % 4) % 9 k, ts as real_ts from events window w as (partition by user_id * 4 + event_id % 4 order by ts, event_id)"""
SCENES = f"""with b as ({TALK}), t as (select id, ord, r,
    case when k = 0 and r > 1 then null when k = 5 then real_ts else timestamp '2024-01-01' + to_seconds(r * case when k = 6 then 1000 else 60 end) end ts,
    case k when 1 then ' Ubottu' when 2 then 'abc'[r % 3 + 1] when 3 then case when r = 1 then 'b' else 'a' end when 4 then case when r <= n / 2 then 'a' else 'b' end else case when r % 2 = 0 then 'A' else 'b ' end end speaker,
    case when k = 4 then 'steady words ' || r when r % 11 = 0 then '* waves hello' when r % 13 = 0 then '{{}}{{}}()[];;##' when r % 17 = 0 then '??? !!!' when r % 19 = 0 then 'spam spam Spam spam' when r % 7 = 0 then 'https://a.example.org/x see http' else 'hello there my friend ' || r end as text from b),
    d as (select id, count(ts) n_dated from t group by id),
    c as (select id, ord, ts, lower(trim(speaker)) speaker, {sql_clean('trim(text)')} cleaned from t where ts is not null and lower(trim(speaker)) not in ({', '.join(map(quoted, fixed.BOTS))})
        and not regexp_matches(trim(text), {quoted(fixed.ACTION)}) and not (length(trim(text)) >= 10 and ({COUNTED('trim(text)', chr(92) + 'p{L}')} / length(trim(text)) < 0.30
        or (length(trim(text)) - length(translate(trim(text), {quoted(fixed.PASTE_SPECIAL)}, ''))) / length(trim(text)) > 0.15 or (length(trim(text)) - length(replace(trim(text), ':', '')) >= 3 and length(trim(text)) < 200)))),
    u as (select * from c where cleaned <> '' and not coalesce((select max(c) / sum(c) > 0.5 and sum(c) >= 4 from (select w, count(*) c from (select unnest({WORDS('cleaned')}) w) group by w)), false)),
    m as (select *, lag(speaker) over w before, date_diff('microsecond', lag(ts) over w, ts) / 1e6 gap, count(*) over (partition by id, speaker) mine from u window w as (partition by id order by ts, ord)),
    s as (select id, count(*) n, count(distinct speaker) speakers, max(mine) / count(*) dominance, coalesce(sum(case when before <> speaker then 1 when before = speaker then 0 end) / nullif(count(*) - 1, 0), 0) alternation,
        max(gap) max_gap, avg(case when gap > 600 then 1.0 when gap is not null then 0.0 end) soft from m group by id),
    r as (select d.id, case when n_dated < 2 then 'too_few_valid_dates' when coalesce(n, 0) < 2 then 'too_few_turns' when speakers <> 2 then 'not_dyadic' when dominance > 0.8 then 'speaker_dominance'
        when alternation < 0.15 then 'low_alternation' when max_gap > 3600 then 'temporal_hard_ceiling' when soft > 0.3 then 'temporal_gap_ratio' else 'kept' end reason from d left join s using (id)) """


def scenes(spark, sf_dir) -> DataFrame:
    """Turns (id, ord, ts, speaker, text) of dialogues that fail each rule, by the remainder of their number."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("id"), F.col("event_id").alias("ord"), "ts")
    w = Window.partitionBy("id").orderBy("ts", "ord")
    e = e.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("id")), "k": F.col("id") % 9})
    r, k, n = F.col("r"), F.col("k"), F.col("n")
    made = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=r * F.when(k == 6, 1000).otherwise(60))
    speaker = (
        F.when(k == 1, " Ubottu").when(k == 2, F.substring(F.lit("abc"), r % 3 + 1, F.lit(1))).when(k == 3, F.when(r == 1, "b").otherwise("a"))
        .when(k == 4, F.when(r <= n / 2, "a").otherwise("b")).otherwise(F.when(r % 2 == 0, "A").otherwise("b "))
    )
    text = (
        F.when(k == 4, F.concat(F.lit("steady words "), r.cast("string"))).when(r % 11 == 0, "* waves hello").when(r % 13 == 0, "{}{}()[];;##").when(r % 17 == 0, "??? !!!")
        .when(r % 19 == 0, "spam spam Spam spam").when(r % 7 == 0, "https://a.example.org/x see http").otherwise(F.concat(F.lit("hello there my friend "), r.cast("string")))
    )
    return e.select("id", "ord", F.when((k == 0) & (r > 1), None).when(k == 5, F.col("ts")).otherwise(made).alias("ts"), speaker.alias("speaker"), text.alias("text"))


@query((SCENES + "select id, reason from r").replace("{{", "{").replace("}}", "}"))
def dialogue_reasons_all(spark, sf_dir):
    """The whole dialogue filter: the first failing of all rules, by dialogue."""
    return corpus.dialogues(scenes(spark, sf_dir))[1]


@query((SCENES + "select reason, count(*) n from r group by reason").replace("{{", "{").replace("}}", "}"))
def dialogue_reason_counts(spark, sf_dir):
    return corpus.dialogues(scenes(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query((SCENES + "select id, ord, speaker, cleaned as text from u").replace("{{", "{").replace("}}", "}"))
def usable_turns(spark, sf_dir):
    """Turns that are left: not by bots, no actions, pastes, repetition, nothing that is empty once cleaned."""
    return dialogue.usable(scenes(spark, sf_dir).filter("ts is not null")).select("id", "ord", "speaker", "text")


UNDATED = f"""with b as ({TALK}) select id, count(*) n_turns, string_agg(cast(ord as varchar), ' ' order by case when ord % 4 = 0 then 1 else 0 end, case when ord % 4 = 0 then null else real_ts end, ord) ords from b group by id"""


@query(UNDATED)
def dialogue_group_dated(spark, sf_dir):
    """Dialogues in order of time; turns without a time come last, as given."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("ts"), F.col("event_type").alias("speaker"), F.lit("").alias("text"))
    return dialogue.grouped(e).select("id", "n_turns", F.array_join(F.transform("turns", lambda x: x["ord"].cast("string")), " ").alias("ords"))


RUNS = """with t as (select conv_id id, turn ord, case when (conv_id + turn) % 3 = 0 then 'B' else lower(substr('aA', cast(turn % 2 + 1 as integer), 1)) end speaker,
    case when turn % 5 = 3 then regexp_extract(text, '[A-Za-z]+') else array_to_string(string_split(text, ' ')[1:6], ' ') end as text from conversations),
    i as (select *, case when lower(speaker) = lag(lower(speaker)) over (partition by id order by ord) then 0 else 1 end new from t),
    g as (select *, sum(new) over (partition by id order by ord) island from i),
    l as (select id, island, min(ord) ord, min_by(speaker, ord) speaker, list(text order by ord) t from g group by id, island) """


@query(RUNS + "select id, ord, speaker, list_reduce(list_transform(t, lambda x, i: case when i = 1 then x else trim(x) end), lambda acc, x: case when x = '' or list_contains(list_transform(string_split(acc, ' '), lambda y: trim(y)), x) then acc else acc || ' ' || x end) as text from l")
def merged_turns(spark, sf_dir):
    """Runs of one speaker become one turn; an utterance that is one word of the run so far is left out."""
    t = turns(spark, sf_dir)
    speaker = F.when((F.col("id") + F.col("ord")) % 3 == 0, "B").otherwise("a")
    text = F.when(F.col("ord") % 5 == 3, F.regexp_extract("text", "[A-Za-z]+", 0)).otherwise(F.array_join(F.slice(F.split("text", " "), 1, 6), " "))
    return dialogue.merged(t.withColumns({"speaker": speaker, "text": text})).select("id", "ord", "speaker", "text")


MERGED = "list_reduce(list_transform(t, lambda x, i: case when i = 1 then x else trim(x) end), lambda acc, x: case when x = '' or list_contains(list_transform(string_split(acc, ' '), lambda y: trim(y)), x) then acc else acc || ' ' || x end)"
UNNAMED = lambda x: f"regexp_replace({x}, {quoted(HIDE_BOTS)}, '__user__', 'g')"  # noqa: E731  the scenes' speakers have names too short to be masked
CORPUS = (
    SCENES.replace("{{", "{").replace("}}", "}")
    + f""", k as (select id, ts, ord, speaker, cleaned from u where id in (select id from r where reason = 'kept')),
    fi as (select id, case when min(ts) < timestamp '2024-01-02' then 'train' when min(ts) < timestamp '2024-01-05' then 'val' else 'test' end split from k group by id),
    ki as (select *, case when speaker = lag(speaker) over (partition by id order by ts, ord) then 0 else 1 end fresh from k),
    kg as (select *, sum(fresh) over (partition by id order by ts, ord) island from ki),
    kl as (select id, island, list(cleaned order by ts, ord) t from kg group by id, island), km as (select id, island, {MERGED} as text from kl),
    kf as (select id, row_number() over w - 1 pos, array_to_string(list(text) over (partition by id order by island rows between 8 preceding and 1 preceding), ' __eot__ ') ctx, text resp from km window w as (partition by id order by island)),
    kh as (select id, pos, {UNNAMED('ctx')} ctx, {UNNAMED('resp')} resp from kf where pos >= 1),
    kk as (select split, id, pos, ctx, resp, row_number() over (partition by split, resp order by id, pos) nth from kh join fi using (id) where {REASON.replace('> 300', '> 40')} = 'kept'),
    ks as (select *, row_number() over (order by md5(id || ':' || pos || ':42')) draw from kk where split = 'train' and nth <= 5),
    made as (select split, id, pos, ctx, resp from ks where draw <= 80 union all select split, id, pos, ctx, resp from kk where split <> 'train') """
)
PLAN = corpus.Config(train_until="2024-01-02", val_until="2024-01-05", cap=5, max_train_pairs=80, strategy=None)
LETTERS = tuple("abcdefghijklmnopqrstuvwxyz0123456789.")


@query(CORPUS + "select split, id, pos, md5(ctx) ctx_md5, md5(resp) resp_md5 from made")
def corpus_pairs(spark, sf_dir):
    """The whole plan from turns to pairs: dialogues filtered, split, merged, masked, framed, pairs filtered, capped and sampled."""
    return corpus.corpus(scenes(spark, sf_dir), PLAN).select("split", "id", "pos", F.md5("ctx").alias("ctx_md5"), F.md5("resp").alias("resp_md5"))


SPELLED = lambda x: f"flatten(list_transform({WORDS(x)}, lambda w: case when list_contains([{', '.join(map(quoted, bpe.SPECIALS))}], w) then [list_position([{', '.join(map(quoted, bpe.SPECIALS))}], w) - 1] else list_transform(string_split('▁' || w, ''), lambda c: coalesce(list_position([{', '.join(map(quoted, ('▁', *LETTERS)))}], c) + 10, 1)) end))"


@query(CORPUS + f", e as (select split, {SPELLED('ctx')} c, {SPELLED('resp')} r from made) select split, md5(array_to_string(c[-100:], ' ')) ctx_md5, md5(array_to_string(list_concat([2], r[1:40], [3]), ' ')) resp_md5, cast(least(len(c), 100) as integer) n_ctx from e")
def corpus_ids(spark, sf_dir):
    """The plan's pairs as ids of a vocabulary of letters."""
    model = bpe.Bpe([*bpe.SPECIALS, bpe.MARK, *LETTERS], [])
    ids = corpus.encoded(corpus.corpus(scenes(spark, sf_dir), PLAN), model, PLAN)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return ids.select("split", joined("ctx").alias("ctx_md5"), joined("resp").alias("resp_md5"), F.size("ctx").alias("n_ctx"))


@query(CLEAN_FRAMED + f", d as (select id, pos, left(resp, 4) resp, ctx, {REASON} reason from p) select id, pos, case when reason = 'kept' and row_number() over (partition by resp, reason = 'kept' order by id, pos) > 1 then 'diversity_cap' else reason end reason from d")
def pair_reasons_capped(spark, sf_dir):
    """All labels of the pair filter in order, the diversity cap last; here responses count as equal by their first four characters."""
    made = clean_pairs(spark, sf_dir)
    rated = made.withColumn("reason", pairs.discard_reason(max_resp=300)).withColumn("resp", F.left("resp", F.lit(4)))
    return pairs.labelled_again(rated, cap=1).select("id", "pos", "reason")


@query(CLEAN_FRAMED + ", s as (select unnest([trim(ctx), trim(resp)]) s from p) select md5(s) sentence_md5, count(*) n from s where s <> '' group by 1")
def sentence_iterator(spark, sf_dir):
    return pairs.sentences(clean_pairs(spark, sf_dir)).groupBy(F.md5("sentence").alias("sentence_md5")).agg(F.count("*").alias("n"))


SIGNALS = {"cmd_in_ctx": f"regexp_matches(ctx, '(?i)\\b({'|'.join(fixed.COMMANDS)})\\b')", "path_in_ctx": "contains(ctx, '__path__')", "cmd_in_resp": f"regexp_matches(resp, '(?i)\\b({'|'.join(fixed.COMMANDS)})\\b')", "path_in_resp": "contains(resp, '__path__')"}
TAGGED = CLEAN_FRAMED + ", q as (select id, pos, ctx || case when id % 3 = 0 then ' sudo ls' else '' end ctx, resp || case when id % 4 = 0 then ' __path__' else '' end resp from p) "


def tagged(spark, sf_dir):
    add = lambda c, k, text: F.concat(F.col(c), F.when(F.col("id") % k == 0, text).otherwise(""))
    return clean_pairs(spark, sf_dir).withColumns({"ctx": add("ctx", 3, " sudo ls"), "resp": add("resp", 4, " __path__")})


@query(TAGGED + ", z as (select count(*) total, " + ", ".join(f"count(case when {v} then 1 end) {k}" for k, v in SIGNALS.items()) + " from q) select signal, n, round(100.0 * n / greatest(total, 1), 1) pct from (select * from z unpivot (n for signal in (" + ", ".join(SIGNALS) + ")))")
def signal_breakdown(spark, sf_dir):
    return pairs.signals(tagged(spark, sf_dir))


@query(TAGGED + f"select id, pos from q where not ({CMD('ctx')} or {CMD('resp')} or {Q})")
def noise_difference(spark, sf_dir):
    """Pairs that the union of both filters leaves out."""
    return tagged(spark, sf_dir).filter(~pairs.domain("union", F.col("ctx"), F.col("resp"))).select("id", "pos")


@query(TAGGED + f", y as (select 100.0 * count(case when {CMD('ctx')} or {CMD('resp')} or {Q} then 1 end) / count(*) u, 100.0 * count(case when ({CMD('ctx')} or {CMD('resp')}) and {Q} then 1 end) / count(*) i from q) select round(u, 1) union_pct, case when u < 40 then 'low' when u > 85 then 'high' else 'expected' end verdict, i < 15 undersized from y")
def union_yield(spark, sf_dir):
    ctx, resp = F.col("ctx"), F.col("resp")
    share = lambda s: 100.0 * F.count_if(pairs.domain(s, ctx, resp)) / F.count("*")
    row = tagged(spark, sf_dir).agg(share("union").alias("u"), share("intersection").alias("i"))
    return row.select(F.round("u", 1).alias("union_pct"), metrics.yield_verdict(F.col("u")).alias("verdict"), (F.col("i") < 15).alias("undersized"))


@query(CLEAN_FRAMED + "select count(*) n, round(100.0 * count(case when contains(ctx, '__eot__') then 1 end) / greatest(count(*), 1), 4) eot_pct, 100.0 * count(case when contains(ctx, '__eot__') then 1 end) / greatest(count(*), 1) < 55 flagged from p")
def eot_coverage(spark, sf_dir):
    pct = 100.0 * F.count_if(F.array_contains(T.tokens(F.col("ctx")), "__eot__")) / F.greatest(F.count("*"), F.lit(1))
    return clean_pairs(spark, sf_dir).agg(F.count("*").alias("n"), pct.alias("p")).select("n", F.round("p", 4).alias("eot_pct"), (F.col("p") < 55).alias("flagged"))


@query(f"select conv_id id, turn ord, md5(coalesce(array_to_string(list_filter(list(t) over (partition by conv_id order by turn rows between 19 preceding and current row), lambda x: x <> ''), ' __eot__ '), '')) history_md5 from (select conv_id, turn, {sql_clean('text')} t from conversations)")
def rolling_history(spark, sf_dir):
    """The last ten exchanges of a chat."""
    return pairs.history(turns(spark, sf_dir), 20).select("id", "ord", F.md5("history").alias("history_md5"))


@query(CLEAN_FRAMED + "select id, pos, right(replace(ctx, '__eot__', '|'), 120) display from p")
def context_display(spark, sf_dir):
    return clean_pairs(spark, sf_dir).select("id", "pos", F.right(F.replace("ctx", F.lit("__eot__"), F.lit("|")), F.lit(120)).alias("display"))


@query(CLEAN_FRAMED + ", n as (select p.*, row_number() over (order by md5(id || ':' || pos || ':42')) k, from p qualify k <= 200) select '── Pair ' || lpad(cast(k as varchar), 3, '0') || chr(10) || 'CTX:  ' || replace(ctx, '__eot__', '|') || chr(10) || 'RESP: ' || resp || chr(10) as value from n".replace(" k, from", " k from"))
def sample_text(spark, sf_dir):
    """Numbered blocks for reading, written and read again as one text each."""
    out = stages.scratch(spark, "samples")
    sinks.sample_lines(clean_pairs(spark, sf_dir)).select(F.replace("value", F.lit("\n"), F.lit("\x1f")).alias("value")).write.text(out)
    return spark.read.text(out).select(F.replace("value", F.lit("\x1f"), F.lit("\n")).alias("value"))


@query("with s as (select text, ['train', 'val', 'test'][cast(doc_id % 3 + 1 as integer)] split from documents), o as (select text, list(distinct split) l from s group by text) select unnest(['train_val', 'train_test', 'val_test']) pair, unnest([count(case when list_contains(l, 'train') and list_contains(l, 'val') then 1 end), count(case when list_contains(l, 'train') and list_contains(l, 'test') then 1 end), count(case when list_contains(l, 'val') and list_contains(l, 'test') then 1 end)]) overlap from o")
def text_leakage(spark, sf_dir):
    """Texts that are in two splits."""
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return dialogue.leakage(table(spark, sf_dir, "documents").select(F.md5("text").alias("id"), split.alias("split")))


@query("select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end split, count(*) n, cast(sum(n_chars) as bigint) chars from documents group by 1")
def split_union(spark, sf_dir):
    """Union of all splits, as the vectors are trained on."""
    docs = table(spark, sf_dir, "documents")
    part = lambda name, c: docs.filter(c).select(F.lit(name).alias("split"), "n_chars")
    k = F.col("doc_id") % 10
    return part("train", k < 8).unionByName(part("val", k == 8)).unionByName(part("test", k == 9)).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select doc_id from documents order by md5(concat_ws(':', cast(doc_id as varchar), '42')) limit (select greatest(1, cast(floor(count(*) * 0.07) as bigint)) from documents)")
def subsample_share(spark, sf_dir):
    return pairs.subsampled(table(spark, sf_dir, "documents"), "doc_id", 0.07).select("doc_id")


# --- arrays of ids ---

IDS = f"(select doc_id, list_transform({WORDS('text')}, lambda w: length(w)) a, list_transform(list_filter({WORDS('text')}, lambda w: regexp_full_match(w, '[a-z]+')), lambda w: length(w)) b from documents)"


def word_ids(spark, sf_dir):
    w = T.tokens(F.col("text"))
    n = lambda a: F.transform(a, F.length)
    return table(spark, sf_dir, "documents").select("doc_id", n(w).alias("a"), n(F.filter(w, lambda x: x.rlike("^[a-z]+$"))).alias("b"))


@query(f"select doc_id, cast(len(c) as bigint) n_ctx, cast(list_sum(c) as bigint) sum_ctx, cast(len(r) as bigint) n_resp, r[1] first, r[len(r)] last, cast(greatest(len(c), 120) as bigint) n_padded, cast(len(list_filter(a, lambda x: x > 3)) as bigint) n_plain from (select doc_id, a, a[greatest(len(a) - 99, 1):] c, list_concat([2], b[1:40], [3]) r from {IDS})")
def id_frames(spark, sf_dir):
    df = word_ids(spark, sf_dir).select("doc_id", "a", A.tail(F.col("a"), 100).alias("c"), A.framed(F.col("b"), 40).alias("r"))
    size = lambda c: F.size(c).cast("long")
    return df.select("doc_id", size("c").alias("n_ctx"), F.when(F.size("c") > 0, F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("sum_ctx"), size("r").alias("n_resp"), F.col("r")[0].alias("first"), F.element_at("r", -1).alias("last"), size(A.padded(F.col("c"), F.lit(120))).alias("n_padded"), size(A.without(F.col("a"), (0, 1, 2, 3))).alias("n_plain"))


@query(f"with e as (select len(a[greatest(len(a) - 99, 1):]) c, len(b[1:40]) + 2 r from {IDS}) select count(*) n_scanned, count(case when c = 0 then 1 end) n_empty_ctx, count(case when r <= 2 then 1 end) n_empty_resp, round(sum(c) / count(*), 1) ctx_mean, round(sum(r) / count(*), 1) resp_mean, count(case when r = (select max(r) from e) then 1 end) n_resp_at_cap from e")
def encoded_pair_stats(spark, sf_dir):
    return pairs.encoded_stats(word_ids(spark, sf_dir).select(A.tail(F.col("a"), 100).alias("ctx"), A.framed(F.col("b"), 40).alias("resp")))


@query(f"select count(*) n_samples, round(sum(len(b)) / count(*), 2) avg_resp_len, round(sum(len(list_filter(b, lambda x: x = 1))) / greatest(sum(len(b)), 1), 4) unk_rate, round(count(case when len(b) = 0 then 1 end) / count(*), 4) empty_rate from {IDS}")
def response_rates(spark, sf_dir):
    return metrics.rates(word_ids(spark, sf_dir), "b")


@query("with t as (select case when lang = 'de' then '<EMPTY>' else left(text, 1) end t, count(*) n from documents group by 1) select round(max(n) / sum(n), 4) top1_fraction, max(n) / sum(n) > 0.20 collapse_flag from t")
def collapse_check(spark, sf_dir):
    return metrics.collapse(table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "de", F.left("text", F.lit(1))).alias("t")), "t")


@query(f"with i as (select doc_id, unnest(list_distinct(a[1:30])) x from {IDS}), j as (select doc_id, string_agg(coalesce(n_name, '<' || x || '>'), ' ' order by x) pieces from i left join nation on n_nationkey = x group by doc_id) select doc_id, coalesce(pieces, '') pieces from documents left join j using (doc_id)")
def decoded_pieces(spark, sf_dir):
    """Ids to pieces by a join; an id without a piece is shown as <id>."""
    vocab = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("piece"))
    ids = word_ids(spark, sf_dir).select("doc_id", F.array_sort(F.array_distinct(F.slice("a", 1, 30))).alias("ids"))
    found = sources.pieces_of(ids, vocab, "doc_id", "ids")
    return ids.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("pieces", " "), F.lit("")).alias("pieces"))


# --- files ---


@query("with l as (select doc_id % 10 k, count(*) n from documents group by 1), r as (select case when k = 1 then 'malformed' when k = 2 then 'missing_key' when k = 3 then 'empty' else 'kept' end reason, n from l where k <> 0) select reason, cast(sum(n) as bigint) n from r group by reason")
def jsonl_counts(spark, sf_dir):
    """Id pairs as JSON lines with blank, broken and incomplete ones; older key names are read too."""
    k = F.col("doc_id") % 10
    line = (
        F.when(k == 0, "").when(k == 1, '{"ctx": [1, 2').when(k == 2, '{"ctx": [4]}').when(k == 3, '{"ctx": [], "resp": [2, 3]}')
        .when(k == 4, '{"src_ids": [5], "trg_ids": [2, 7, 3]}').otherwise('{"ctx":[5,6],"resp":[2,8,3]}')
    )
    out = stages.scratch(spark, "lines")
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(out)
    return sources.read_pairs(spark, out)[1]


@query("select doc_id, len(a) n_ctx, len(b) + 2 n_resp from (select doc_id, a[greatest(len(a) - 99, 1):] a, b[1:40] b from " + IDS + ") where len(a) > 0")
def jsonl_pairs(spark, sf_dir):
    """Pairs written as JSON lines and read again."""
    out = stages.scratch(spark, "pairs")
    df = word_ids(spark, sf_dir).filter(F.size("a") > 0)
    # the row's number goes in front of the context, so that it can be told after reading
    sinks.write_pairs(df.select(F.concat(F.array(F.col("doc_id").cast("int")), A.tail(F.col("a"), 100)).alias("ctx"), A.framed(F.col("b"), 40).alias("resp")), out)
    back = sources.read_pairs(spark, out, max_ctx=101)[0]
    return back.select(F.col("ctx")[0].cast("long").alias("doc_id"), (F.size("ctx") - 1).cast("long").alias("n_ctx"), F.size("resp").cast("long").alias("n_resp"))


@query("select 'line ' || doc_id as value from documents order by doc_id limit 50")
def bounded_scan(spark, sf_dir):
    """The first lines of a file."""
    out = stages.scratch(spark, "scan")
    ordered = table(spark, sf_dir, "documents").select("doc_id").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.concat(F.lit("line "), F.col("doc_id").cast("string")).alias("value")).write.text(out)
    return sources.read_lines(spark, out, 50).select("value")


@query("select item_id, md5(text) text_md5 from benchmark")
def pair_array(spark, sf_dir):
    """A JSON document that is an array of pairs."""
    out = stages.scratch(spark, "array")
    rows = table(spark, sf_dir, "benchmark").agg(F.to_json(F.collect_list(F.struct(F.col("item_id").cast("string").alias("ctx"), F.col("text").alias("resp")))).alias("value"))
    rows.write.text(out)
    return sources.read_pair_array(spark, out).select(F.col("ctx").cast("long").alias("item_id"), F.md5("resp").alias("text_md5"))


@query("select case when doc_id % 4 = 0 then cast(doc_id as varchar) else source || '/' || doc_id end id, case when doc_id % 5 = 0 then null else timestamp '2024-01-01 00:00:00' + to_seconds(doc_id) end ts, lang speaker, md5(trim(text)) text_md5 from documents where doc_id % 7 <> 0 and trim(text) <> ''")
def csv_turns(spark, sf_dir):
    """A CSV file of turns, quoted texts with line breaks included; the id is of folder and dialogue; rows without a speaker are left out."""
    out, n = stages.scratch(spark, "csv"), F.col("doc_id")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=n)
    rows = table(spark, sf_dir, "documents").select(
        F.when(n % 4 == 0, "").otherwise(F.col("source")).alias("folder"), n.cast("string").alias("dialogueID"), F.when(n % 5 == 0, "2024").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(n % 7 == 0, " ").otherwise(F.col("lang")).alias("from"), "text",
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return sources.read_turns(spark, out).select("id", "ts", "speaker", F.md5("text").alias("text_md5"))


@query("select event_id, case event_id % 6 when 0 then ts when 1 then date_trunc('second', ts) when 2 then date_trunc('second', ts) when 3 then cast(date_trunc('day', ts) as timestamp) end parsed from events")
def date_parse(spark, sf_dir):
    """The four accepted forms of dates; others are null."""
    k, ts = F.col("event_id") % 6, F.col("ts")
    given = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format(ts, "yyyy-MM-dd")).when(k == 4, "2008").otherwise("junk")
    return table(spark, sf_dir, "events").select("event_id", T.parse_date(given).alias("parsed"))


@query("select doc_id, source || ' done' plain from documents")
def ansi_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_ansi(F.concat(F.lit("\x1b[31;1m"), "source", F.lit("\x1b[0m\r \x1b]0;title\x07done"))).alias("plain"))


NATION = "(select n_name piece, n_nationkey id from nation)"


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("piece"), F.col("n_nationkey").cast("int").alias("id"))


@query(f"select piece, cast(id as integer) id from {NATION}")
def vocab_file(spark, sf_dir):
    """A vocabulary as one JSON object, nested under word2idx, read again."""
    out = stages.scratch(spark, "vocab")
    nations(spark, sf_dir).agg(F.map_from_entries(F.collect_list(F.struct("piece", "id"))).alias("m")).select(F.to_json(F.struct(F.col("m").alias("word2idx"))).alias("value")).write.text(out)
    return sources.read_vocab(spark, out)


@query(f"select cast(id as varchar) id, piece from {NATION}")
def idx2word_file(spark, sf_dir):
    out = stages.scratch(spark, "idx")
    sinks.write_idx2word(nations(spark, sf_dir), out)
    return spark.read.text(out).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "piece"))


@query(f"select s_suppkey, coalesce((select id from {NATION} where piece = n), 1) as id, coalesce((select piece from {NATION} where id = s_suppkey), '<unk>') as piece from (select s_suppkey, case when s_suppkey % 3 = 0 then 'ATLANTIS' else (select n_name from nation where n_nationkey = s_nationkey) end n from supplier)")
def tokenizer_lookup(spark, sf_dir):
    """Piece to id and id to piece by inverted maps, with their defaults."""
    pieces = nations(spark, sf_dir)
    named = table(spark, sf_dir, "supplier").join(nations(spark, sf_dir).withColumnRenamed("id", "nation"), F.col("s_nationkey") == F.col("nation"))
    name = F.when(F.col("s_suppkey") % 3 == 0, "ATLANTIS").otherwise(F.col("piece"))
    rows = named.select("s_suppkey", name.alias("name")).join(pieces.select(F.col("piece").alias("name"), "id"), "name", "left")
    rows = rows.join(pieces.select(F.col("id").alias("s_suppkey"), "piece"), "s_suppkey", "left")
    return rows.select("s_suppkey", F.coalesce("id", F.lit(1)).alias("id"), F.coalesce("piece", F.lit("<unk>")).alias("piece"))


@query("select vec_id id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) norm from embeddings")
def matrix_file(spark, sf_dir):
    """A matrix written as NPY parts and read again."""
    out = stages.scratch(spark, "matrix")
    sinks.write_matrix(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), out)
    return sources.read_matrix(spark, out).select("id", F.round(A.norm(F.col("vec")), 4).alias("norm"))


def made_files(spark, folder: str, files: list[tuple[str, int]]) -> None:
    for name, size in files:
        store, at = stages.hadoop_path(spark, f"{folder}/{name}")
        file = store.create(at)
        file.write(bytearray(b"x" * size))
        file.close()


KINDS = "case n_nationkey % 5 when 0 then 'best' when 1 then 'last' when 2 then 'notes' else 'step' end"


@query(f"select name, kind, step, cast(row_number() over (order by array_position(['best', 'last', 'step', 'other'], kind), step, name) as integer) as place from (select k || '_' || n_nationkey * 7 || '.txt' as name, case k when 'notes' then 'other' else k end as kind, case when k = 'step' then cast(n_nationkey * 7 as bigint) end as step from (select *, {KINDS} as k from nation))")
def checkpoint_list(spark, sf_dir):
    """Checkpoints of a folder, in order: best, last, steps ascending, others."""
    folder = stages.scratch(spark, "checkpoints")
    names = table(spark, sf_dir, "nation").select(F.concat(F.expr(KINDS), F.lit("_"), (F.col("n_nationkey") * 7).cast("string"), F.lit(".txt"))).collect()  # a nation is a file
    made_files(spark, folder, [(r[0], 5) for r in names])
    found = stages.checkpoints(spark, folder).collect()
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(found)], "name string, kind string, step long, place int")


@query("select unnest(['first', 'again', 'removed']) as run, unnest([count(*), count(*), 1]) as n, unnest([1, 1, 1]) as made from region")
def stage_cache(spark, sf_dir):
    """A stage is made once and read afterwards, until it is cleaned up."""
    folder, calls = stages.scratch(spark, "stages"), []

    def make():
        calls.append(1)
        return table(spark, sf_dir, "region")

    rows = [(run, stages.stage(spark, folder, "regions", make).count(), len(calls)) for run in ("first", "again")]
    rows.append(("removed", len(stages.cleaned_up(spark, folder, ["regions", "none"])), len(calls)))
    return spark.createDataFrame(rows, "run string, n long, made int")


@query("select unnest(['there', 'missing']) as document, unnest([count(*), null]) as n, unnest([cast(sum(n_nationkey) as bigint), null]) as total from nation")
def json_document(spark, sf_dir):
    """A JSON document is loaded; a missing one is None."""
    out = stages.scratch(spark, "document")
    nations(spark, sf_dir).agg(F.collect_list("id").alias("ids")).write.json(out)
    missing = sources.read_json(spark, f"{out}-missing")
    there = sources.read_json(spark, out).select(F.lit("there").alias("document"), F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))
    none = spark.createDataFrame([("missing", None, None)], "document string, n long, total long")
    return there.unionByName(none) if missing is None else there


@query("select 'm' || n_nationkey as id, n_name as name, 'lstm' as architecture, 'best_' || n_nationkey as checkpoint from nation")
def registry_file(spark, sf_dir):
    """The registry of models: a JSON array of objects, read with its fields; fields that are not given are null."""
    out = stages.scratch(spark, "registry")
    key = F.col("id").cast("string")
    rows = nations(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("m"), key).alias("id"), F.col("piece").alias("name"), F.lit("lstm").alias("architecture"), F.concat(F.lit("best_"), key).alias("checkpoint")))).alias("value"))
    rows.write.text(out)
    return sources.read_registry(spark, out).filter("tokenizer is null and dataset is null and description is null").select("id", "name", "architecture", "checkpoint")


@query("select replace(lower(n_name), ' ', '_') || '.csv' as name from nation where n_nationkey % 4 > 0 order by n_nationkey * 7 % 11 desc, name limit 1")
def largest_file(spark, sf_dir):
    """Of a folder's CSV files the largest is read; the first by name among equals. A nation is a file, its size depends on its key."""
    folder = stages.scratch(spark, "discovered")
    end = F.when(F.col("n_nationkey") % 4 > 0, ".csv").otherwise(".txt")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), end), (F.col("n_nationkey") * 7 % 11 + F.when(end == ".txt", 99).otherwise(1)).cast("int")).collect()
    made_files(spark, folder, [tuple(r) for r in rows])
    path = sources.largest_csv(spark, folder)
    return spark.createDataFrame([(path.rsplit("/", 1)[-1],)], "name string")


# --- reports ---


def counts_by_source(spark, sf_dir, lang: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter((F.col("lang") == lang) & (F.col("doc_id") % 11 != 0)).groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("value"))


METRIC_TABLE = "with b as (select source metric, count(*) v from documents where lang = 'en' and doc_id % 11 <> 0 group by 1), a as (select source metric, count(*) v from documents where lang = 'es' and doc_id % 11 <> 0 group by 1), m as (select coalesce(b.metric, a.metric) metric, b.v baseline, a.v attention from b full outer join a on a.metric = b.metric) "


@query(METRIC_TABLE + "select * from m")
def metric_table(spark, sf_dir):
    return metrics.metric_table({"baseline": counts_by_source(spark, sf_dir, "en"), "attention": counts_by_source(spark, sf_dir, "es")})


@query(METRIC_TABLE + "select cast(row_number() over (order by metric) + 3 as integer) as line, '| ' || metric || ' | ' || coalesce(cast(baseline as varchar), '—') || ' | ' || coalesce(cast(attention as varchar), '—') || ' |' as value from m union all select unnest([0, 1, 2, 3]), unnest(['## Layer 1', '', '| Metric | Baseline | Attention |', '|---|---|---|'])")
def markdown_report(spark, sf_dir):
    return sinks.markdown(metric_table(spark, sf_dir), "Layer 1")


@query("with b as (select source metric, count(*) v from documents where lang = 'en' and doc_id % 11 <> 0 group by 1) select '{' || string_agg('\"' || metric || '\":' || v, ',' order by metric) || '}' as value from b")
def results_file(spark, sf_dir):
    out = stages.scratch(spark, "results")
    sinks.results_json(counts_by_source(spark, sf_dir, "en")).write.text(out)
    return spark.read.text(out)


@query("select 'loss/' || event_type tag, event_id step, value from events where event_id % 5 < 2")
def scalar_log(spark, sf_dir):
    """Scalars appended twice, read as one table."""
    out = stages.scratch(spark, "scalars")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("loss/"), "event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    for k in (0, 1):
        sinks.append_scalars(rows.filter(F.col("step") % 5 == k), out)
    return spark.read.parquet(out)


@query("select vec_id sample_id, cast((i - 1) // 8 as integer) t, cast((i - 1) % 8 as integer) s, round(cast(embedding[i] as double), 5) + 0.0 weight from embeddings, (select unnest(range(1, 65)) i)")
def attention_table(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8))).alias("attn"))
    return sinks.attention_long(rows).withColumn("weight", F.round(F.col("weight").cast("double"), 5) + 0.0)


@query("select c_custkey, c_nationkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey < 2)")
def registry_semi(spark, sf_dir):
    """Rows of which the registry holds the model."""
    registry = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(registry, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("with l as (select user_id model, extract(day from ts) epoch, case when event_id % 50 = 0 then null else value end loss from events), m as (select model, epoch, coalesce(avg(loss), 0) mean_loss from l group by all) select model, cast(epoch as integer) epoch, round(mean_loss, 6) mean_loss, round(ln(exp(least(mean_loss, 20))), 6) log_perplexity from m")
def loss_by_epoch(spark, sf_dir):
    """Mean loss over finite batches, and perplexity (here its logarithm), by epoch."""
    loss = F.when(F.col("event_id") % 100 == 0, float("nan")).when(F.col("event_id") % 50 == 0, float("inf")).otherwise(F.col("value"))
    df = metrics.epoch_losses(table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.dayofmonth("ts").alias("epoch"), loss.alias("loss")))
    return df.select("model", "epoch", F.round("mean_loss", 6).alias("mean_loss"), F.round(F.log("perplexity"), 6).alias("log_perplexity"))


@query("with m as (select user_id model, extract(day from ts) epoch, avg(value) loss from events group by all) select model, cast(min_by(epoch, loss) as integer) best_epoch, round(min(loss), 6) best_loss from m group by model")
def best_epoch(spark, sf_dir):
    batches = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.dayofmonth("ts").alias("epoch"), "value")
    losses = batches.groupBy("model", "epoch").agg(metrics.exact_mean(F.col("value")).alias("mean_loss"))
    return metrics.best_epochs(losses).withColumn("best_loss", F.round("best_loss", 6))


@query(f"select vec_id, round(16 / (0.01 * (vec_id % 9 + 1)), 1) tokens_per_sec, cast(round(10.0 * (vec_id % 9 + 1), 1) as double) latency_ms, round(list_sum(list_transform(embedding[1:16], lambda x: abs(cast(x as double)))) / 16, 4) avg_confidence, cast(vec_id % 4 as integer) unk_in_input, 16 response_len, cast(vec_id % 4 + 5 as integer) input_tokens from embeddings")
def inference_metrics(spark, sf_dir):
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(1), F.lit(16)).alias("ids"), F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x.cast("double"))).alias("c"), (0.01 * (k % 9 + 1)).alias("s"), F.concat(F.array_repeat(F.lit(7), 5), F.array_repeat(F.lit(1), (k % 4).cast("int"))).alias("src"))
    return metrics.inference(rows, "ids", "c", "s", "src").drop("ids", "c", "s", "src")


FACTS = ("with s as (select source stage, count(*) n, count(distinct text) u, count(case when lang = 'fr' then 1 end) fr, count(case when n_chars < 200 then 1 end) short, max(doc_id) m from documents group by 1), "
    "f as (select stage, unnest(['discard_pct', 'val_pct', 'test_pct', 'coverage_pct', 'n_empty_ctx', 'n_empty_resp', 'diversity_ratio', 'at_cap_pct', 'over_100', 'over_500', 'eot_pct']) metric, "
    "unnest([100.0 * fr / n, 100.0 * short / n, case when m % 2 = 0 then 2.0 else 5.0 end, 100.0 * u / n, short % 3, m % 2, case when m % 5 = 0 then 0.2 else u / n end, fr, m % 90, m % 3, case when m % 7 = 0 then null else 50.0 + m % 20 end]::double[]) v from s) ")  # fmt: skip


@query(FACTS + """select stage, metric, round(v, 6) as value, case when v is null then 'missing'
    when metric = 'discard_pct' and v > 20 then 'high discard rate' when metric = 'val_pct' and v < 3 then 'small validation split' when metric = 'test_pct' and v < 3 then 'small test split' when metric = 'coverage_pct' and v < 95 then 'low coverage'
    when metric = 'n_empty_ctx' and v > 0 then 'empty contexts' when metric = 'n_empty_resp' and v > 0 then 'near-empty responses' when metric = 'diversity_ratio' and v < 0.3 then 'potential collapse' when metric = 'at_cap_pct' and v > 5 then 'truncation bias'
    when metric = 'over_100' and v > 50 then 'dominance risk' when metric = 'over_500' and v > 0 then 'diversity filter' when metric = 'eot_pct' and v < 55 then 'separators missing' else 'ok' end flag from f""")
def stage_validations(spark, sf_dir):
    """Flags of each stage's statistics."""
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("text").alias("u"), F.count_if(F.col("lang") == "fr").alias("fr"), F.count_if(F.col("n_chars") < 200).alias("short"), F.max("doc_id").alias("m"))
    m, n = F.col("m"), F.col("n")
    facts = {
        "discard_pct": 100.0 * F.col("fr") / n, "val_pct": 100.0 * F.col("short") / n, "test_pct": F.when(m % 2 == 0, 2.0).otherwise(5.0), "coverage_pct": 100.0 * F.col("u") / n, "n_empty_ctx": F.col("short") % 3,
        "n_empty_resp": m % 2, "diversity_ratio": F.when(m % 5 == 0, 0.2).otherwise(F.col("u") / n), "at_cap_pct": F.col("fr"), "over_100": m % 90, "over_500": m % 3, "eot_pct": F.when(m % 7 != 0, 50.0 + m % 20),
    }
    long = s.select("stage", *[c.cast("double").alias(k) for k, c in facts.items()]).unpivot(["stage"], list(facts), "metric", "value")
    return metrics.validations(long).withColumn("value", F.round("value", 6))


@query("""with m as (select c_custkey k from customer) select k, coalesce(nullif(concat_ws(',', case when (k % 10) / 20.0 > 0.20 or (k % 7) / 10.0 > 0.30 then 'COLLAPSE' end,
    case when coalesce(b, 1.0) < 0.05 or coalesce(v > 0.95 * ln(16000), false) then 'NOT_LEARNING' end, case when coalesce(v - k % 3 > 0.5, false) then 'OVERFIT' end), ''), 'OK') verdict
    from (select k, case when k % 13 = 0 then null else (k % 5) / 50.0 end b, case when k % 13 = 0 then null else cast(k % 11 as double) end v from m)""")
def verdict_flags(spark, sf_dir):
    """The verdict with each flag alone and together, and with metrics missing."""
    k = F.col("c_custkey")
    there = lambda c: F.when(k % 13 != 0, c)
    v = metrics.verdict(there((k % 5) / 50.0), there((k % 11).cast("double")), k % 3, (k % 10) / 20.0, (k % 7) / 10.0, F.lit(16000))
    return table(spark, sf_dir, "customer").select(k.alias("k"), v.alias("verdict"))


# --- generation metrics ---

TOKENS_13A = lambda x: WORDS(__import__("functools").reduce(lambda t, r: f"regexp_replace({t}, {quoted(r[0])}, {quoted(r[1].replace('$', chr(92)))}, 'g')", fixed.TOKENS_13A, f"' ' || replace(replace(replace(replace(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"))
SPOKEN_13A = f"""with b as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) before from conversations),
    s as (select conv_id * 1000 + turn sample_id, {TOKENS_13A('text')} hyp, {TOKENS_13A('before')} ref from b where role = 'assistant' and before is not null) """


def orders_13a() -> str:
    from .catalog import CLIP

    parts = " union all ".join(f"select n, matched, total from {CLIP(n)}" for n in (1, 2, 3, 4))
    log = lambda n: f"ln(case when (select matched from p where n = {n}) > 0 then (select matched from p where n = {n}) else pow(2.0, -(select count(*) from p where n <= {n} and matched = 0)) end / greatest((select total from p where n = {n}), 1))"
    score = lambda n: f"round(case when (select min(total) from p where n <= {n}) > 0 then bp * exp(({' + '.join(log(i) for i in range(1, n + 1))}) / {n}) else 0 end, 4) bleu{n}"
    return f", p as ({parts}), z as (select case when sum(len(hyp)) = 0 then 0.0 when sum(len(hyp)) >= sum(len(ref)) then 1.0 else exp(1 - sum(len(ref)) / greatest(sum(len(hyp)), 1)) end bp from s) select {', '.join(map(score, (1, 2, 3, 4)))} from z"


@query(SPOKEN_13A + orders_13a())
def bleu_corpus_13a(spark, sf_dir):
    """Corpus BLEU-1 to BLEU-4 with 13a words."""
    inside = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(inside)).filter("role = 'assistant' and before is not null")
    return metrics.bleu_13a(df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), F.col("text").alias("hyp"), F.col("before").alias("ref")))


LCS = SPOKEN.replace("with b as", "with recursive b as", 1) + """, l(sample_id, i, best) as (select sample_id, 0, list_transform(range(len(ref) + 1), lambda x: 0) from s union all
    select l.sample_id, i + 1, list_concat([0], list_transform(range(1, len(ref) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda j: greatest(best[j + 1], case when ref[j] = hyp[i + 1] then best[j] + 1 else 0 end)))))
    from l join s using (sample_id) where i < len(hyp)), r as (select s.sample_id, len(hyp) h, len(ref) f, best[len(best)] n from l join s using (sample_id) where i = len(hyp)) """
ORACLES["rouge_l"] = LCS + "select sample_id, case when n = 0 then 0.0 else 2.0 * n / (h + f) end rouge_l from r"


@query(LCS + "select round(avg(case when n = 0 then 0.0 else 2.0 * n / (h + f) end), 6) rouge_l, count(*) n from r")
def rouge_l_mean(spark, sf_dir):
    df = metrics.rouge_l_mean(spoken(spark, sf_dir))
    return df.withColumn("rouge_l", F.round("rouge_l", 6))


# --- embedding audits ---

PIECES = "(select vec_id id, case when vec_id < 11 then (" + "[" + ", ".join(map(quoted, bpe.SPECIALS)) + "])[cast(vec_id + 1 as integer)] else 'w' || vec_id end piece, label, embedding vec from embeddings)"
COS = lambda a, b: f"list_cosine_similarity({a}::double[], {b}::double[])"


def piece_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    piece = F.when(F.col("vec_id") < 11, F.get(F.array(*map(F.lit, bpe.SPECIALS)), F.col("vec_id").cast("int"))).otherwise(F.concat(F.lit("w"), F.col("vec_id").cast("string")))
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    return e.select(piece.alias("piece"), F.col("vec_id").alias("id")), e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") == 0, zero).otherwise(F.col("embedding")).alias("vec"))


WORD_IDS = {"w20": 20, "w30": 31, "none": 7}


@query("select 'B' as section, unnest(['vocabulary size', 'pad row zero', 'sentinel rows', 'tag rows', 'filled rows', " + ", ".join(quoted(f"id of {p}") for p in [*bpe.SPECIALS, *WORD_IDS]) + "]) as name, unnest(['PASS', 'PASS', 'PASS', 'PASS', 'PASS', " + ", ".join(["'PASS'"] * len(bpe.SPECIALS)) + ", 'PASS', 'FAIL', 'FAIL']) as status from (select 1 where (select count(*) from embeddings where list_sum(list_transform(embedding, lambda x: x * x)) <= 1e-12) = 0)")
def audit_alignment(spark, sf_dir):
    return vectors.audit_alignment(*piece_tables(spark, sf_dir), bpe.SPECIALS, WORD_IDS)


RELATED = [(f"w{a}", f"w{a + 1}", f"w{a + 2}") for a in range(20, 60, 4)] + [("w20", "missing", "w21")]
APART = [("<s>", "</s>"), ("<unk>", "</s>"), ("<s>", "<unk>"), *((a, b) for i, a in enumerate(bpe.SPECIALS[4:]) for b in bpe.SPECIALS[5 + i :])]


@query(f"with p as {PIECES}, t as (select unnest([{', '.join(f'({quoted(a)}, {quoted(b)}, {quoted(c)})' for a, b, c in RELATED)}]) t), v as (select t[1] a, t[2] b, t[3] c, (select vec from p where piece = t[1]) va, (select vec from p where piece = t[2]) vb, (select vec from p where piece = t[3]) vc from t) "
    f"select 'G' as section, a || ' ' || b || ' ' || c as name, case when va is null or vb is null or vc is null then 'SKIP' when {COS('va', 'vb')} > {COS('va', 'vc')} then 'PASS' else 'WARN' end status from v "
    f"union all select 'G', a.piece || ' ' || b.piece, case when {COS('a.vec', 'b.vec')} < 0.95 then 'PASS' else 'WARN' end from (select unnest([{', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in APART)}]) x) y join p a on a.piece = x[1] join p b on b.piece = x[2]")  # fmt: skip
def audit_meaning(spark, sf_dir):
    return vectors.audit_meaning(*piece_tables(spark, sf_dir), RELATED, APART)


def batch_ids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select((F.col("vec_id") % 7).alias("row"), F.col("vec_id").alias("at"), F.when(F.col("vec_id") % 5 == 0, 0).otherwise(F.col("vec_id")).alias("id"))
    return rows


@query("select 'H' as section, unnest(['padding is zero', 'rows of the matrix', 'shape', 'no zero rows']) as name, 'PASS' as status")
def audit_lookup(spark, sf_dir):
    return vectors.audit_lookup(piece_tables(spark, sf_dir)[1], batch_ids(spark, sf_dir), 64)


@query(f"select cast(vec_id % 7 as bigint) as row, vec_id as at, case when vec_id % 5 = 0 then 0 else vec_id end id, case when vec_id % 5 = 0 then 0 else round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) end norm from embeddings")
def batch_lookup(spark, sf_dir):
    found = vectors.looked_up(batch_ids(spark, sf_dir), piece_tables(spark, sf_dir)[1], 64)
    return found.select("row", "at", "id", F.round(A.norm(F.col("vec")), 4).alias("norm"))


@query()
def audit_summary(spark, sf_dir):
    """Counts of statuses over sections A, B, G and H, and the exit code."""
    vocab, matrix = piece_tables(spark, sf_dir)
    whole = vectors.audit(matrix.filter("id > 0"), "vec", 64).unionByName(audit_alignment(spark, sf_dir)).unionByName(audit_meaning(spark, sf_dir)).unionByName(audit_lookup(spark, sf_dir))
    return vectors.summary(whole)


ORACLES["audit_summary"] = (
    "with a as (select 'PASS' status from range(3)), b as (select status from (" + ORACLES["audit_alignment"] + ")), g as (select status from (" + ORACLES["audit_meaning"] + ")), h as (select status from (" + ORACLES["audit_lookup"] + ")), "
    "w as (select * from a union all select * from b union all select * from g union all select * from h) "
    "select count(case when status = 'PASS' then 1 end) n_pass, count(case when status = 'WARN' then 1 end) n_warn, count(case when status = 'FAIL' then 1 end) n_fail, count(case when status = 'SKIP' then 1 end) n_skip, count(*) total, cast(count(case when status = 'FAIL' then 1 end) > 0 as integer) exit_code from w"
)


@query(f"select vec_id, round({COS('embedding', '(select embedding from embeddings where vec_id = 3)')}, 6) cosine from embeddings where vec_id <> 3 order by cosine desc, vec_id limit 5")
def nearest_five(spark, sf_dir):
    """The five nearest of a stated vector, itself not among them."""
    df = table(spark, sf_dir, "embeddings")
    return vectors.nearest(df, df.filter("vec_id = 3").first()["embedding"], "vec_id", "embedding", 5, but=3)


@query("select case when count(*) = 0 then 0 else count(*) end n_filled, (select count(*) from embeddings) n_rows from embeddings where vec_id > 0 and vec_id % 6 <> 0")
def matrix_filled(spark, sf_dir):
    """How many rows of the matrix a vector was found for."""
    vocab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("piece"))
    vec = table(spark, sf_dir, "embeddings").filter("vec_id % 6 <> 0").select(F.col("vec_id").cast("string").alias("piece"), F.col("embedding").alias("vec"))
    return vectors.matrix(vocab, vec, 64).agg(F.count_if(A.norm(F.col("vec")) > 1e-6).alias("n_filled"), F.count("*").alias("n_rows"))


# --- decoding ---

STEPS = "(select vec_id // 10 sample_id, vec_id % 10 step, embedding[1:12] logits from embeddings)"


def steps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("sample_id"), (F.col("vec_id") % 10).alias("step"), F.slice("embedding", 1, 12).alias("logits"))


@query(f"with b as (select sample_id, step, list_position(logits, list_max(logits)) - 1 id from {STEPS}), e as (select *, min(case when id = 3 then step end) over (partition by sample_id) stop from b) select sample_id, coalesce(string_agg(case when stop is null or step < stop then cast(id as varchar) end, ' ' order by step), '') ids from e group by sample_id")
def greedy_decode(spark, sf_dir):
    return decoding.greedy(steps(spark, sf_dir)).select("sample_id", F.array_join("ids", " ").alias("ids"))


@query("with e as (select vec_id, unnest(embedding[1:12]) x, unnest(range(12)) i from embeddings), s as (select *, exp((cast(x as double) - max(x) over (partition by vec_id)) / 0.8) w from e), p as (select *, w / sum(w) over (partition by vec_id) p from s), c as (select *, coalesce(sum(p) over (partition by vec_id order by p desc, i rows between unbounded preceding and 1 preceding), 0) ahead from p), k as (select vec_id, p from c where ahead <= 0.9) select vec_id, cast(count(*) as integer) n_kept, round(max(p) / sum(p), 6) top_p from k group by vec_id")
def nucleus_top(spark, sf_dir):
    """Softmax with a temperature, then the nucleus: how many ids are left and the largest probability."""
    p = A.nucleus(A.softmax(F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")), 0.8), 0.9)
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.size(F.filter("p", lambda x: x > 0)).alias("n_kept"), F.round(F.array_max("p"), 6).alias("top_p"))


@query(f"with i as (select doc_id, a[1:60] a from {IDS}) select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(a) - 1), lambda j: a[j:j + 1] = a[len(a) - 1:len(a)]), lambda j: a[j + 2]))), ' '), '') blocked from i")
def blocked_ids(spark, sf_dir):
    """Ids that would repeat a trigram of the sequence."""
    ids = word_ids(spark, sf_dir).select("doc_id", F.slice("a", 1, 60).alias("a"))
    return ids.select("doc_id", F.array_join(F.array_sort(A.blocked(F.col("a"), 3)), " ").alias("blocked"))


@query("with b as (select vec_id // 10 sample_id, vec_id % 10 beam, cast(embedding[1] as double) - 5 logp, 1 + vec_id % 6 n from embeddings), s as (select *, logp / pow(greatest(n, 1), 0.7) score from b), r as (select *, row_number() over (partition by sample_id order by score desc, beam) k from s) select sample_id, beam, round(score, 6) score from r where k <= 3")
def beam_prune(spark, sf_dir):
    b = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("sample_id"), (F.col("vec_id") % 10).alias("beam"), (F.col("embedding")[0].cast("double") - 5).alias("logp"), (1 + F.col("vec_id") % 6).alias("length"))
    return decoding.beams(b, 3).select("sample_id", "beam", F.round("score", 6).alias("score"))


def beam_sql(width: int = 3, n_steps: int = 4) -> str:
    """The loop of `beam_search` written out, for logits that depend on the step alone."""
    out = f"""with q as (select sample_id, step, unnest(range(12)) id, unnest(list_transform(logits, lambda x: cast(x as double))) x from {STEPS}),
        g as (select sample_id, step, id, x - ln(sum(exp(x)) over (partition by sample_id, step)) lp from q), n as (select * from (select *, row_number() over (partition by sample_id, step order by lp desc, id) k from g) where k <= {width}),
        a0 as (select distinct sample_id, []::bigint[] ids, 0.0::double logp from q)"""
    for i in range(n_steps):
        score = "logp" if i == 0 else f"logp / pow({i + 1}, 0.7)"
        out += f""", m{i} as (select a.sample_id, a.ids before, a.logp + n.lp logp, n.id from a{i} a join n on n.sample_id = a.sample_id and n.step = {i}),
            d{i} as (select sample_id, before ids, {score} score from m{i} where id = 3),
            a{i + 1} as (select sample_id, ids, logp from (select sample_id, list_append(before, id) ids, logp, row_number() over (partition by sample_id order by logp / pow({i + 1}, 0.7) desc, list_append(before, id)) k from m{i} where id <> 3) where k <= {width})"""
    done = " union all ".join(f"select * from d{i}" for i in range(n_steps)) + f" union all select sample_id, ids, logp / pow({n_steps}, 0.7) from a{n_steps}"
    return out + f" select sample_id, array_to_string(ids, ' ') ids, round(score, 6) score from (select *, row_number() over (partition by sample_id order by score desc, ids) k from ({done})) where k = 1"


@query(beam_sql())
def beam_search(spark, sf_dir):
    """Beam search over distributions by step."""
    logits = steps(spark, sf_dir).withColumn("x", F.transform("logits", lambda x: x.cast("double")))
    log_sum = F.log(A.total(F.transform("x", F.exp)))
    long = logits.withColumn("z", log_sum).select("sample_id", "step", "z", F.posexplode("x").alias("id", "x")).withColumn("lp", F.col("x") - F.col("z"))
    best = long.withColumn("k", F.row_number().over(Window.partitionBy("sample_id", "step").orderBy(F.desc("lp"), "id"))).filter("k <= 3").select("sample_id", "step", "id", "lp")
    scores = lambda beams: beams.withColumn("step", F.size("ids").cast("long")).join(best, ["sample_id", "step"])
    found = decoding.beam_search(scores, logits.select("sample_id").distinct(), width=3, steps=4)
    return found.select("sample_id", F.array_join("ids", " ").alias("ids"), F.round("score", 6).alias("score"))


@query()
def top_p_decode(spark, sf_dir):
    """Sampling from the nucleus with blocked trigrams; draws are hashes of sample and step."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "sample_id", "step")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return decoding.top_p_decode(steps(spark, sf_dir).withColumn("u", u)).select("sample_id", F.array_join("ids", " ").alias("ids"))


@query("with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings), g as (select vec_id, list_transform(range(4), lambda t: list_sum(list_transform(range(1, 9), lambda j: e[56 + j] * tanh(e[t * 8 + j] + e[32 + j])))) g from e), w as (select vec_id, list_transform(g, lambda x, i: case when i = vec_id % 4 + 1 then 0.0 else exp(x) end) w from g) select vec_id, array_to_string(list_transform(w, lambda x: cast(cast(round(x / list_sum(w) * 10000) as bigint) as varchar)), ' ') weights from w")
def additive_attention(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice("e", t * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i == F.col("vec_id") % 4)
    w = decoding.attention(F.slice("e", 33, 8), keys, F.slice("e", 57, 8), mask)
    return e.select("vec_id", F.array_join(F.transform(w, lambda x: F.round(x * 10000).cast("long").cast("string")), " ").alias("weights"))


@query("select * from (select unnest(range(11)) id, unnest([" + ", ".join(map(quoted, bpe.SPECIALS)) + "]) tag, true is_single) union all select unnest(range(11)), unnest([" + ", ".join(quoted(s + "x") for s in bpe.SPECIALS) + "]), false")
def special_tokens(spark, sf_dir):
    """Special tokens of a learned vocabulary are single pieces in their places."""
    from .catalog import vocabulary

    model = vocabulary(spark, sf_dir)
    found = bpe.integrity(model) + bpe.integrity(model, tuple(f"{s}x" for s in bpe.SPECIALS))  # words that only begin with a tag are none
    return spark.createDataFrame([(i, s, ok) for s, i, ok in found], "id long, tag string, is_single boolean")


# --- streams ---


@query("with g as (select user_id, ts, case when ts < lag(ts) over w + interval 12 hours then 0 else 1 end new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) k from g) select user_id, min(ts) as start, max(ts) + interval 12 hours as \"end\", count(*) n from s group by user_id, k")
def stream_session_window(spark, sf_dir):
    """The stream of events run to its end; all its sessions, the open ones too."""
    out = sessions.replayed(spark, table(spark, sf_dir, "events"), stages.scratch(spark, "sessions"), "12 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"select conv_id, turn, {sql_clean('text')} clean from conversations")
def stream_clean_text(spark, sf_dir):
    """Cleaning of a stream of turns."""
    out = stages.scratch(spark, "cleaned")
    source = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(sessions.watched(f"{sf_dir}/conversations.parquet"))
    done = sessions.cleaned(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{out}/rows").select("conv_id", "turn", F.col("text").alias("clean"))


@query(ORACLES["rolling_history"])
def stream_history(spark, sf_dir):
    """The last ten exchanges of a chat, as state of a stream that is stopped and started again between three parts of the turns."""
    out = stages.scratch(spark, "history")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("ord"))
    rows = turns(spark, sf_dir).select("id", "ord", at.alias("ts"), "text")
    for k in range(3):
        rows.filter(F.least(F.floor(F.col("ord") / 4), F.lit(2)) == k).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
        done = history.rolling(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        done.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "ord", F.md5("history").alias("history_md5"))


@query("select 'loss/' || event_type tag, event_id step, value from events")
def stream_scalars(spark, sf_dir):
    """Scalars of a stream appended batch by batch; the last batch comes twice."""
    out = stages.scratch(spark, "scalars")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("loss/"), "event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    for k in range(2):
        part = rows.filter(F.col("step") % 2 == k)
        part.write.mode("append").parquet(f"{out}/in")
        history.scalars(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), f"{out}/rows", f"{out}/state").awaitTermination()
    history.append_batch(part, 1, f"{out}/rows")
    return spark.read.parquet(f"{out}/rows").select("tag", "step", "value")


@query(CLEAN_FRAMED + f"select count(*) n, count(case when {NW('resp')} < 5 then 1 end) n_short, count(case when {REASON} = 'kept' then 1 end) n_kept, max(pos) last_pos from p")
def observed_pairs(spark, sf_dir):
    """Counts taken in the pass that writes a stage."""
    made = clean_pairs(spark, sf_dir)
    kept = pairs.discard_reason(max_resp=300) == "kept"
    seen = stages.observed(made, stages.scratch(spark, "pairs"), n=F.count("*"), n_short=F.count_if(T.n_words(F.col("resp")) < 5), n_kept=F.count_if(kept), last_pos=F.max("pos"))
    return spark.createDataFrame([tuple(seen[k] for k in ("n", "n_short", "n_kept", "last_pos"))], "n long, n_short long, n_kept long, last_pos long")
