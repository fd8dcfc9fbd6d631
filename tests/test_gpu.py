from servops.operators import gpu as G


def test_csv_rules_and_metrics(spark):
    lines = spark.createDataFrame([
        (1, None, "0, NVIDIA RTX A6000, 45, 20, 1024, 24576, 100.5, 300"),
        (2, None, ""),                                           # blank: skipped
        (3, None, "1, NVIDIA A100, 50, 80"),                     # too short: skipped
        (4, None, "2, NVIDIA H100 PCIe, 40, [N/A], 512, 0, [N/A], 350"),  # bad cells -> null, total 0
        (5, None, "  3 ,\tTesla T4 , 30 , 50 , 100 , 200 , 1 , 2 , extra"),
    ], "sample_id long, ts timestamp_ntz, line string")
    s = {r.sample_id: r for r in G.parse_gpu_samples(lines).collect()}
    assert sorted(s) == [1, 4, 5]
    assert s[4].utilization is None and s[4].power_draw is None and s[4].mem_total == 0.0
    assert s[5].gpu_index == 3 and s[5].name == "Tesla T4"
    m = {r.sample_id: r for r in G.gpu_metrics(G.parse_gpu_samples(lines)).collect()}
    assert m[1].short_name == "A6000" and m[1].utilization_band == "low"
    assert abs(m[1].memory_pct - 1024 / 24576 * 100) < 1e-12 and m[1].mem_used_gb == 1.0
    assert m[4].memory_pct is None and m[4].memory_band is None and m[4].utilization_band is None
    assert m[5].memory_band == "mid"


def test_process_view(spark):
    lines = spark.createDataFrame([(1, "0, 1234, python -m vllm.entrypoints.openai.api_server, 2048"),
                                   (2, "1, 99, short, 10"), (3, "1, 5")], "sample_id long, line string")
    v = {r.pid: r for r in G.gpu_process_view(G.parse_gpu_processes(lines)).collect()}
    assert v[1234].display_name == "python -m vllm.ent..." and v[1234].memory_gb == 2.0
    assert v[99].display_name == "short" and v[99].type == "C" and len(v) == 2
