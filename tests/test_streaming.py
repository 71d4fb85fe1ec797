import os
import tempfile

from chronotile.params import FIXTURE
from chronotile.plans import stages as S
from chronotile.sources import fixtures as fx
from chronotile.streaming.ingest import ingest


def test_available_now_matches_batch(spark, sf_small):
    root = tempfile.mkdtemp(prefix="chronotile-stream-")
    ev = S.events(spark, sf_small)
    ev.write.parquet(os.path.join(root, "events"))
    snaps = fx.tile_snapshots(spark, sf_small, ev)
    q = ingest(spark, os.path.join(root, "events"), snaps, S.image_vectors(spark, sf_small), FIXTURE,
               os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(root, "out")).select("event_id").collect()
    want = S.changes(spark, sf_small).select("event_id").collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in want)
