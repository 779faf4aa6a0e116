from listwright.operators.profile import Profile, Ranking
from listwright.plans import search as S
from listwright.sources.files import manual_csv
from listwright.sources.listing import gather

NOW = "2024-02-01 00:00:00"


def test_end_to_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "url,title,company,location,description,posted_at\n"
        'https://x.example/1,Senior C# Developer,Acme A/S,"Copenhagen, Denmark",C# and .NET hybrid,2024-01-30\n'
        "https://x.example/1#again,Senior C# Developer,Acme,Copenhagen,other,2024-01-30\n"
        "https://y.example/9,senior c# developer,ACME,Copenhagen K,copy,2024-01-30\n"
        "https://x.example/2,Marketing Manager,Acme,Copenhagen,campaigns,2024-01-30\n"
        "https://x.example/3,Unpaid C# intern,Acme,Copenhagen,C#,2024-01-30\n"
    )
    person = Profile(name="A", location="Copenhagen, Denmark", remote_preference="hybrid", seniority="senior", primary_stack=("C#", ".NET"), disqualifiers=("unpaid",))
    rules = Ranking(min_score=0.3, top_n=5)
    result = S.search(gather([manual_csv(spark, f"{tmp_path}/a.csv", "m", NOW)]), person, rules, NOW)
    assert result.deduped.count() == 3
    assert [len(r["merged"]) for r in result.merges.collect()] == [2]
    assert [r["title"] for r in result.shortlist.collect()] == ["Senior C# Developer"]
    assert {r["drop_reason"] for r in result.dropped.collect()} == {"below_min_score", "disqualifier"}
    counts = S.run_counts(result).first()
    assert (counts["deduped_count"], counts["shortlist_count"], counts["dropped_count"]) == (3, 1, 2)
    report = S.markdown_report(result.shortlist, "Run")
    assert "## 1. Senior C# Developer — Acme A/S" in report and report.index("- primary_stack") < report.index("- freshness")
    S.write_run(result, str(tmp_path / "out"), "20240201-000000-abcdef")
    back = S.read_runs(spark, str(tmp_path / "out"), "dropped", "seq long, title string, drop_reason string")
    assert back.count() == 2 and {r["run_id"] for r in back.collect()} == {"20240201-000000-abcdef"}
