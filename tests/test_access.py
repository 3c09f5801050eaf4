"""The access matrix and its neighbours."""

import pytest
from helpers import rows

from vitalgrid.operators import access

A = "access_control"
OWNER, VIEWER, OTHER = 1, 2, 3


def tables(spark, base, filtered):
    perms = [(10, OWNER, m, None) for m in base] + [(10, OWNER, m, VIEWER) for m in filtered]
    return (
        spark.createDataFrame(perms, "group_id bigint, user_id bigint, metric_type string, shared_with_user_id bigint"),
        spark.createDataFrame([(10, u, "accepted") for u in (1, 2, 3)], "group_id bigint, user_id bigint, status string"),
    )


@pytest.mark.parametrize(
    "base, filtered, viewer_sees, others_see",
    [
        (["hr", "spo2"], [], {"hr", "spo2"}, {"hr", "spo2"}),
        (["hr", "spo2"], [A, "spo2"], {"spo2"}, {"hr", "spo2"}),
        (["hr", "spo2"], [A], set(), {"hr", "spo2"}),
        (["spo2"], [A, "hr"], set(), {"spo2"}),
        (["hr"], ["spo2"], {"hr"}, {"hr"}),  # a specific row alone filters nothing
    ],
)
def test_matrix(spark, base, filtered, viewer_sees, others_see):
    perms, members = tables(spark, base, filtered)
    asked = spark.createDataFrame(
        [(v, OWNER, m) for v in (VIEWER, OTHER) for m in ("hr", "spo2")], "observer_id bigint, target_id bigint, metric_type string"
    )
    verdicts = {(r.observer_id, r.metric_type) for r in access.check_access(asked, perms, members).collect() if r.verdict == "allowed"}
    assert verdicts == {(VIEWER, m) for m in viewer_sees} | {(OTHER, m) for m in others_see}
    pairs = asked.selectExpr("target_id AS owner_id", "metric_type")
    let = {(r.viewer_id, r.metric_type) for r in access.authorised_members(pairs, perms, members).collect()}
    assert let == verdicts


def test_own_data(spark):
    perms, members = tables(spark, ["hr"], [])
    asked = spark.createDataFrame([(1, 1, "hr")], "observer_id bigint, target_id bigint, metric_type string")
    assert access.check_access(asked, perms, members).first().verdict == "allowed"
    assert access.check_access(asked, perms, members, own="error").first().verdict == "self_not_allowed"


def test_leaving_the_group_ends_access(spark):
    perms, members = tables(spark, ["hr"], [])
    asked = spark.createDataFrame([(2, 1, "hr")], "observer_id bigint, target_id bigint, metric_type string")
    for gone in (1, 2):
        left = members.filter(members.user_id != gone)
        assert access.check_access(asked, perms, left).first().verdict == "denied"


def test_visible_metrics_does_not_consult_the_base(spark):
    perms, members = tables(spark, ["spo2"], [A, "hr"])
    viewers = spark.createDataFrame([(10, VIEWER), (10, OTHER)], "group_id bigint, viewer_id bigint")
    got = {r.viewer_id: r.metrics for r in access.visible_metrics(perms, members, viewers).collect()}
    assert got == {VIEWER: ["hr"], OTHER: ["spo2"]}


def test_orphans(spark):
    perms, _ = tables(spark, ["hr"], ["hr"])
    assert rows(access.orphan_permissions(perms)) == [(10, 1, "hr", 2)]
