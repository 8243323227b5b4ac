"""Session helpers: the shared checkpoint folder comes from the session; cluster settings are byte-sized."""

from tidewater.session import CHECKPOINT_CONF, checkpoint_dir, cluster_conf, ensure_utc


def test_checkpoint_dir_reads_the_session_setting(spark):
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    assert configured                                   # set by the environment or by the test session
    assert checkpoint_dir(spark) == configured


def test_cluster_conf_sizes_by_bytes():
    conf = cluster_conf(executors=1000, cores_per_executor=8)
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert int(conf["spark.sql.files.maxPartitionBytes"]) == 256 * 1024 * 1024
    assert int(conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) == 32000
    assert conf["spark.sql.session.timeZone"] == "UTC" and conf["spark.ui.enabled"] == "false"


def test_ensure_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    ensure_utc(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
