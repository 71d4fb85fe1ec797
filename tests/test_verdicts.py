from chronotile.operators.verdicts import parse_verdicts


#: answer text -> (is_real, change_type, cause_tr, confidence)
EXPECTED = [
    ('{"is_real": true, "change_type": "construction", "cause_tr": "bina", "confidence": 0.8}', (True, "construction", "bina", 0.8)),
    ('Sonuc: {"is_real": false, "change_type": "water", "confidence": 0.3} tamam', (False, "water", "", 0.3)),
    ("gecersiz", (None, "", "", 0.0)),
    ("[1, 2]", (None, "", "", 0.0)),
    ('{"is_real": "false", "change_type": "volcano"}', (True, "", "", 0.0)),
    ('{"is_real": 0, "confidence": "0.25"}', (False, "", "", 0.25)),
    ('{"is_real": 1, "confidence": "high"}', (None, "", "", 0.0)),
    ('{"is_real": 1, "confidence": "0.5d"}', (None, "", "", 0.0)),
    ('{"is_real": [], "change_type": ["water"]}', (None, "", "", 0.0)),
    ('{"is_real": [1], "cause_tr": null}', (True, "", None, 0.0)),
    ('{"confidence": true}', (False, "", "", 1.0)),
    ("{}", (False, "", "", 0.0)),
]


def test_parse_verdicts(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(EXPECTED)], "event_id long, text string")
    got = {r.event_id: (r.ai_is_real, r.ai_change_type, r.ai_cause_tr, r.ai_confidence) for r in parse_verdicts(df).collect()}
    for i, (text, want) in enumerate(EXPECTED):
        assert got[i] == want, text
