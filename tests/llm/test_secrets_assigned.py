from phenogrid.llm import secrets

KEY, HEX = "ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
LINES = [
    ("API_KEY=", KEY, True),
    ("export token=", HEX, True),
    ("SECOND_SECRET_TOKEN_2=", HEX, True),
    ("client_secret=", "Zx9Kp2Lm8Qw4Rt6Yb1Nc3VdA7sD5fG==", True),
    ("auth_token=", JWT, True),
    ("commit=", HEX, False),
    ("sha256=", HEX + HEX[:24], False),
    ("checksum=", HEX[:32], False),
]


def test_unquoted_assignments_by_exact_span(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    df = spark.createDataFrame([(i, f"{name}{value}\nnext=1\n") for i, (name, value, _) in enumerate(LINES)], "doc_id int, text string")
    found = {(r["doc_id"], r["start"], r["end"], r["candidate"]) for r in secrets.find_secrets(df, model).collect()}
    assert found == {(i, len(name), len(name) + len(value), value) for i, (name, value, secret) in enumerate(LINES) if secret}


def test_padding_counts_towards_the_least_length(spark):
    df = spark.createDataFrame([(0, "x=QUJDREVGR0hJSjE="), (1, "x: QUJDREVGR0hJ1Q=="), (2, "x=QUJDREVGR0h1Q==")], "doc_id int, text string")
    assert {(r["doc_id"], r["start"], r["candidate"]) for r in secrets.candidates(df, "doc_id", "text").collect()} == {(0, 2, "QUJDREVGR0hJSjE="), (1, 3, "QUJDREVGR0hJ1Q==")}
