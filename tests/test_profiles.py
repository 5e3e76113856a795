from inkmesh.operators import geo, stats

COLUMNS = "rec_id long, year int, cites int, countries array<string>, keywords array<string>, affiliations array<string>, authors array<string>, source string, refs array<string>"


def corpus(spark):
    return spark.createDataFrame(
        [
            (1, 2000, 5, ["USA"], ["Graphs", "Trees"], ["Acme Univ, Boston, USA"], ["Okonkwo, M"], "J Nets", ["Fell A, 1980, J SETS, V1, P1", "Bo C, 1985, J SETS, V2, P2"]),
            (2, 2003, 1, ["United States", "USA", "FRA"], ["graphs"], ["Acme Univ, Boston, USA", "Univ Lyon, France"], ["Okonkwo, M", "Petit, L"], "J Nets", ["Fell A., 1980, J SETS, V1, P1", "Future Z, 2030, J X, V1, P1"]),
            (3, 2003, None, ["France"], None, None, None, None, ["Fell A, 1980, J SETS, V1, P1;", "Low B, 1980, J ABC, V3, P4", None]),
            (4, None, 7, ["Nowhereland", None], ["Trees"], ["Acme Univ"], ["Petit, L"], "J Nets", None),
            (5, 2003, 2, ["US"], ["Graphs"], ["Acme Univ, Boston, USA"], ["Petit, L"], "Other", []),
        ],
        COLUMNS,
    )


def test_country_profiles(spark):
    x = corpus(spark)
    got = {r["country"]: tuple(r)[1:] for r in geo.country_summary(x).collect()}
    us, fr = got["United States"], got["France"]
    assert set(got) == {"United States", "France"}
    assert us[:6] == (3, 8, 2, 1, 2000, 2003) and abs(us[6] - (2 ** (1 / 3) - 1)) < 1e-12
    assert fr == (2, 1, 1, 1, 2003, 2003, 0.0)
    years = [tuple(r)[1:] for r in geo.country_years(x).where("country = 'United States'").orderBy("year").collect()]
    assert years == [(2000, 1, 5.0), (2001, 0, 0.0), (2002, 0, 0.0), (2003, 2, 1.5)]
    tops = [tuple(r) for r in geo.country_tops(x).where("country = 'United States'").orderBy("what", "place").collect()]
    assert [(w, p, n) for _, w, p, _, _, n in tops] == [("authors", 1, 2), ("authors", 2, 2), ("keywords", 1, 3), ("keywords", 2, 1), ("orgs", 1, 2), ("sources", 1, 2), ("sources", 2, 1)]
    assert [t[4] for t in tops if t[1] == "keywords"] == ["Graphs", "Trees"]
    assert not geo.country_tops(x).where("country = 'France' and what = 'orgs'").count()  # its only record with one shares it
    for f in (geo.country_summary, geo.country_years, geo.country_tops):
        assert f(x.limit(0)).count() == 0


def test_peaks_of_cited_years(spark):
    x = corpus(spark)
    got = [tuple(r) for r in stats.rpys_peaks(x).collect()]
    assert got == [(1980, 4, 4.0, "fella1980jsetsv1p1", "Fell A, 1980, J SETS, V1, P1", 3), (1985, 1, 1.0, "boc1985jsetsv2p2", "Bo C, 1985, J SETS, V2, P2", 1)]
    assert [r["year"] for r in stats.rpys_peaks(x, 1990, 1983).collect()] == [1985] and stats.rpys_peaks(x, top=1).count() == 1
    assert stats.rpys_peaks(x.limit(0)).count() == 0 and stats.rpys_peaks(x.where("rec_id > 3")).count() == 0
