"""Queries of question packs and contracts, from the results ledger and the instrument screen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.operators import contracts
from macrotide.plans.registry import query
from macrotide.sources.panels import RESULTS, results

FIELDS = {"sample_split_id": "full", "resid_mode": "crossfit", "fold_spec": "k5", "seed": 42}
JOBS = f"""with {RESULTS}, jb as (select row_number() over (order by treatment, outcome, estimator) as job, treatment, case when outcome = '5-LOW' and estimator = 'dml' then ' ' else outcome end as outcome, list(horizon order by horizon) filter (p < 0.5) as horizons, estimator as mode from results group by treatment, outcome, estimator)"""
TOKEN = "lower(regexp_replace(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


def _jobs(spark, d):
    """A job for each treatment, outcome and estimator of the ledger, with the horizons at which p is below 0.5; some name no outcome."""
    rows = results(spark, d).groupBy("treatment", "outcome", "estimator").agg(F.array_sort(F.collect_list(F.when(F.col("p") < 0.5, F.col("horizon")))).alias("horizons"))
    rows = rows.withColumn("job", F.row_number().over(Window.orderBy("treatment", "outcome", "estimator")))  # a row for each job
    outcome = F.when((F.col("outcome") == "5-LOW") & (F.col("estimator") == "dml"), " ").otherwise(F.col("outcome"))
    return rows.select("job", "treatment", outcome.alias("outcome"), "horizons", F.col("estimator").alias("mode"))


def _packs(spark, d):
    return contracts.question_packs(_jobs(spark, d), horizon_end=3, enabled_limit=6, exclude={"treatment": ["BUILDING"]}, settings={"alpha": 0.05})


PACKS = f"""{JOBS}, jj as (select *, case when trim(outcome) = '' then 'no_outcome' when treatment = 'BUILDING' then 'excluded' end as skip_reason from jb),
pk as (select treatment, outcome, min(job) as first_job, max(coalesce(list_max(horizons), 3)) as top, string_agg(distinct mode, ',' order by mode) as modes from jj where skip_reason is null group by all),
pq as (select *, 'auto_' || {TOKEN.format('treatment')} || '_' || {TOKEN.format('outcome')} as question_id, row_number() over (order by first_job) as index from pk)"""


@query("question_packs", f"""{PACKS} select treatment, outcome, null::bigint as job, question_id, 'Auto: ' || treatment || ' -> ' || outcome as label, index <= 6 as enabled, -4 as horizon_start, greatest(3, top)::integer as horizon_end, modes, null::varchar as skip_reason, 0.05::double as alpha from pq
union all select treatment, trim(outcome), job, null, null, null, null, null, null, skip_reason, 0.05 from jj where skip_reason is not null""")
def _(spark, d):
    return _packs(spark, d).withColumn("job", F.col("job").cast("long"))


@query("question_pack_grid", f"""{PACKS} select question_id, treatment, outcome, h as horizon, d as design from pq, (select unnest([-4, 0, 2, 5]) as h), (select unnest(['event', 'did']) as d) where index <= 6 and h between -4 and greatest(3, top)""")
def _(spark, d):
    return contracts.pack_questions(_packs(spark, d), [-4, 0, 2, 5], ["event", "did"])


LISTS = f"""with {RESULTS}, iv as (select treatment, outcome as candidate, case when horizon % 2 = 0 then 'Diff ' end as transform, horizon - 2 as lag, p < 0.5 as selected from results where estimator = 'lp'),
nc as (select case when horizon % 3 = 0 then treatment when horizon % 3 = 1 then 'NOBODY' end as treatment, outcome as target_outcome, outcome || '/' || horizon as nc_outcome, case when horizon < 6 then horizon end as rank, round(abs(z), 6) as score, p < 0.7 as selected from results where estimator = 'dml'),
qm as (select distinct treatment, outcome, horizon - 2 as horizon from results where estimator = 'lp' and treatment <> 'MACHINERY' and p < 0.8), qa as (select * from qm where horizon >= 0), qp as (select distinct treatment, outcome from qa)"""
CONTRACTS = f"""{LISTS}, mt as (select nc.*, q.treatment as own from nc join qp q on q.outcome = nc.target_outcome where selected and (q.treatment = nc.treatment or not exists (select 1 from qp where qp.treatment = nc.treatment and qp.outcome = nc.target_outcome))),
bs as (select *, row_number() over (partition by own, target_outcome order by rank nulls last, score desc, nc_outcome) as k from mt),
ct as (select unnest(['iv_lp', 'iv_dml']) as contract_type, iv.treatment, qa.outcome, candidate as instrument, '' as nc_outcome, '' as force_w_series, lower(trim(coalesce(transform, 'raw'))) || '_lag' || greatest(lag, 0) as w_spec, qa.horizon from iv join qa using (treatment) where selected
  union all select 'nc_test', own, target_outcome, '', nc_outcome, '', 'default', qa.horizon from mt join qa on qa.treatment = own and qa.outcome = target_outcome
  union all select 'nc_adjust_main', own, target_outcome, '', nc_outcome, nc_outcome, 'default', qa.horizon from bs join qa on qa.treatment = own and qa.outcome = target_outcome where k = 1),
cs as (select *, 'full' as sample_split_id, 'crossfit' as resid_mode, 'k5' as fold_spec, 42 as seed, contract_type || '_' || substr(sha1(concat_ws('|', contract_type, treatment, outcome, instrument, nc_outcome, force_w_series, w_spec, horizon, 'full', 'crossfit', 'k5', 42)), 1, 16) as contract_id from ct)"""


def _lists(spark, d):
    """Instruments, controls and a question map made of the ledger: some not selected, some for no question."""
    rows = results(spark, d)
    lp, dml, h = rows.filter("estimator = 'lp'"), rows.filter("estimator = 'dml'"), F.col("horizon")
    iv = lp.select("treatment", F.col("outcome").alias("candidate"), F.when(h % 2 == 0, "Diff ").alias("transform"), (h - 2).alias("lag"), (F.col("p") < 0.5).alias("selected"))
    nc = dml.select(F.when(h % 3 == 0, F.col("treatment")).when(h % 3 == 1, "NOBODY").alias("treatment"), F.col("outcome").alias("target_outcome"), F.concat_ws("/", "outcome", h.cast("string")).alias("nc_outcome"), F.when(h < 6, h).alias("rank"), F.round(F.abs("z"), 6).alias("score"), (F.col("p") < 0.7).alias("selected"))
    return iv, nc, lp.filter("treatment <> 'MACHINERY' and p < 0.8").select("treatment", "outcome", (h - 2).alias("horizon")).distinct()


@query("iv_nc_contracts", f"{CONTRACTS} select * from cs")
def _(spark, d):
    return contracts.contracts(*_lists(spark, d), FIELDS)


@query("contract_skips", f"""{LISTS} select 'instrument' as kind, treatment, '' as outcome, candidate as name, case when not selected then 'not_selected' else 'no_question' end as reason from iv where not selected or treatment not in (select treatment from qa)
union all select 'control', coalesce(treatment, ''), target_outcome, nc_outcome, case when not selected then 'not_selected' else 'no_question' end from nc where not selected or target_outcome not in (select outcome from qa)""")
def _(spark, d):
    return contracts.contract_skips(*_lists(spark, d))


@query("permutation_targets", f"{CONTRACTS} select distinct treatment, outcome, horizon, w_spec from cs where contract_type in ('iv_lp', 'nc_test')")
def _(spark, d):
    return contracts.permutation_targets(contracts.contracts(*_lists(spark, d), FIELDS))
