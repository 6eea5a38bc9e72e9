"""clipmill: build labelled-audio training sets with Spark DataFrames.

The package turns a catalogue of projects, files, annotations and exports into
reproducible train/validation/test datasets of canonical 16 kHz mono WAV clips.

    sources/    manifests, clips, saved catalogue pages, written datasets
    functions/  Column expressions and the Arrow WAV codec
    operators/  filters, joins, splits, aggregates, paging, table changes
    sinks/      split datasets, manifests, dataset cards
    plans/      the composed jobs: freeze, materialize, adapt, listings
    streaming/  incremental adaptation of arriving manifests
"""

from clipmill.spec import ExportSpec, SplitPolicy

__all__ = ["ExportSpec", "SplitPolicy"]
