"""FASTQ files that are read whole instead of sampled."""

from __future__ import annotations

import gzip

import pytest

from strandcheck.plans import preflight
from strandcheck.sources.storage import list_files

READS = 50_020
TEXT = "".join(f"@r{i} 1\nACGT\n+\nIII{'I' if i % 2 else '5'}\n" for i in range(READS)) + "@bad\nACGT\n+\nIII\n"


@pytest.mark.parametrize("name", ["s_R1.fastq", "s_R1.fastq.gz"])
def test_every_record_counts(spark, tmp_path, name):
    """More reads than a sample takes, plain and packed; the metrics are exact then."""
    (tmp_path / name).write_bytes(gzip.compress(TEXT.encode()) if name.endswith("gz") else TEXT.encode())
    result = preflight.analyze_fastqs(list_files(spark, str(tmp_path)), "whole")
    facts = result.summary.first()
    assert (facts["reads"], facts["bases"], facts["malformed"], facts["first_header"]) == (READS, 4 * READS, 1, "@r0 1")
    assert facts["strategy"].endswith("full file") and facts["error"] is None
    provenance = preflight.fastq_metrics(result).filter("metric = 'reads'").select("provenance", "value").first()
    assert tuple(provenance) == ("EXACT", float(READS))
    sample = preflight.analyze_fastqs(list_files(spark, str(tmp_path)))
    assert sample.summary.first()["reads"] == 50_000 and not sample.whole
