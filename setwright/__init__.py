"""setwright: training-set exports as Spark jobs."""

from setwright.operators.ledger import Ledger
from setwright.operators.mean import image_mean, mean_vector, save_mean, subtract_mean
from setwright.operators.shards import greedy_shards
from setwright.plans.export import export, split_report, verify_against_feed, verify_local, written_files
from setwright.sources.arrays import array_records
from setwright.sources.feed import accepted, read_feed, read_pages, rejected
from setwright.sources.job import Job, load_job, read_jobs

__all__ = [
    "Job",
    "Ledger",
    "accepted",
    "array_records",
    "export",
    "greedy_shards",
    "image_mean",
    "load_job",
    "mean_vector",
    "read_feed",
    "read_jobs",
    "read_pages",
    "rejected",
    "save_mean",
    "split_report",
    "subtract_mean",
    "verify_against_feed",
    "verify_local",
    "written_files",
]
