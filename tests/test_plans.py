"""The physical plans the library relies on at scale."""

import os

from logwarden.cluster import shared_folder
from logwarden.operators import detect, profile, ranks
from logwarden.plans import driver_tables as dt
from logwarden.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_shuffle_events_once_per_key_and_stay_in_the_jvm(spark):
    text = plan(detect.ip_features(dt.events(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text
    assert "partial_count" in text and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in text


def test_samples_are_pruned_before_the_shuffle_and_keys_broadcast(spark):
    events = dt.events(spark, SF)
    kept = detect.rank_and_cap(detect.detect(events))
    text = plan(detect.sample_events(kept, events, bounded=True))
    assert text.count("WindowGroupLimit") >= 2 and "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    df = dt.table(spark, SF, "lineitem").where("l_returnflag = 'R'")
    text = plan(profile.moments(df, ["l_tax"]))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in text


def test_order_statistics_never_sort_all_rows_in_one_task(spark):
    text = plan(ranks.exact_quantiles(dt.table(spark, SF, "lineitem"), "l_extendedprice", {"m": 0.5}))
    for line in text.splitlines():
        if "Window [" in line:
            assert "bucket" in line


def test_every_query_has_a_check_or_is_a_fitted_model():
    missing = set(queries()) - set(oracle_sql())
    assert missing == {"isolation_forest_scores", "full_sample_forest", "batch_scores", "lof_scores", "one_class_scores", "forest_sweep", "forest_importances",
                       "grid_search", "detector_operating_points", "stream_scores"}


def test_the_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(shared_folder(spark).replace("file:", ""))
