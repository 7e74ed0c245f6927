"""Built-in patterns for terminal inverted repeat elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: File, group, pattern, seed letters, TSD letters, note.
ELEMENTS = [
    ('00_DTC_published_2025.pat', 'DTC', 'p1=3...3 CACTA[0,0,0] p2=7...7 500...15000 ~p2 TAGTG[0,0,0] p1', 12, '3', 'published; supplied example'),
    ('01_DTT_seed12.pat', 'DTT', 'TA[0,0,0] p2=12...12 50...30000 ~p2 TA[0,0,0]', 12, '2', 'TA TSD; no family-specific TIR motif'),
    ('01_DTT_Stowaway_seed12.pat', 'DTT', 'TA[0,0,0] CTCCTCCC[0,0,0] p2=4...4 50...30000 ~p2 GGGAGGAG[0,0,0] TA[0,0,0]', 12, '2', 'Stowaway motif subset only'),
    ('02_DTA_seed8.pat', 'DTA/DTP/DTE ambiguous', 'p1=8...8 p2=8...8 50...30000 ~p2 p1', 8, '8', '8-bp TSD; not diagnostic of hAT alone'),
    ('02_DTA_short5to7.pat', 'DTA/DTP/DTE ambiguous', 'p1=8...8 p2=5...7 50...30000 ~p2 p1', 5, '8', 'short-TIR recovery; high false-positive burden'),
    ('03_DTM_G_seed20.pat', 'DTM', 'p1=9...11 G[0,0,0] p2=19...19 50...30000 ~p2 C[0,0,0] p1', 20, '9', 'G/C-terminal subset; misses absent or divergent TIRs'),
    ('03_DTM_unanchored_seed20.pat', 'DTM candidate', 'p1=9...11 p2=20...20 50...30000 ~p2 p1', 20, '9', '9-11-bp TSD with no terminal-base constraint'),
    ('04_DTE_seed20.pat', 'DTE candidate', 'p1=8...9 p2=20...20 50...30000 ~p2 p1', 20, '8', '8-bp branch overlaps DTA/DTP; requires homology evidence'),
    ('05_DTR_CAC_seed15.pat', 'DTR candidate', 'p1=5...5 CAC[0,0,0] p2=12...12 50...30000 ~p2 GTG[0,0,0] p1', 15, '5', 'CAC motif supported by Kapitonov/Jurka 2005; exact seed is heuristic'),
    ('05_DTR_unanchored_seed15.pat', 'DTR candidate', 'p1=5...5 p2=15...15 50...30000 ~p2 p1', 15, '5', 'motif-independent 5-bp TSD fallback'),
    ('06_DTP_seed12.pat', 'DTP/DTA/DTE ambiguous', 'p1=8...8 p2=12...12 50...30000 ~p2 p1', 12, '8', 'not a P-specific terminal signature'),
    ('07_DTB_seed12.pat', 'DTB candidate', 'TTAA[0,0,0] p2=12...12 50...30000 ~p2 TTAA[0,0,0]', 12, '4', 'TTAA is the TSD, not the TIR'),
    ('08_DTH_seed12.pat', 'DTH/DTC and other 3-bp-TSD candidates', 'p1=3...3 p2=12...12 50...30000 ~p2 p1', 12, '3', 'broad 3-bp TSD screen; not DTH-specific'),
    ('08_DTH_TWA_seed12.pat', 'DTH preferred-target subset', 'p1=TWA[0,0,0] p2=12...12 50...30000 ~p2 p1', 12, '3', 'TWA=TAA or TTA; p1 enforces identical TSDs'),
    ('08_DTH_Tourist_seed8.pat', 'Tourist-like candidate', 'p1=3...3 p3=S[0,0,0] p2=7...7 50...30000 ~p2 ~p3 p1', 8, '3', 'S=G/C captured as actual base; mirrors RiTE motif criterion, not a quoted published pattern'),
    ('09_DTC_CACTA_seed12.pat', 'DTC plant CACTA subset', 'p1=3...3 CACTA[0,0,0] p2=7...7 50...30000 ~p2 TAGTG[0,0,0] p1', 12, '3', 'expanded spacer window; 12-bp exact terminal seed'),
    ('09_DTC_CACTG_seed12.pat', 'DTC plant CACTG subset', 'p1=3...3 CACTG[0,0,0] p2=7...7 50...30000 ~p2 CAGTG[0,0,0] p1', 12, '3', 'CACTG reverse complement is CAGTG'),
    ('09_DTC_CACTA_seed10.pat', 'DTC plant CACTA subset', 'p1=3...3 CACTA[0,0,0] p2=5...5 50...30000 ~p2 TAGTG[0,0,0] p1', 10, '3', 'recovers exact TIRs as short as 10 bp; lower specificity'),
    ('09_DTC_CACTG_seed10.pat', 'DTC plant CACTG subset', 'p1=3...3 CACTG[0,0,0] p2=5...5 50...30000 ~p2 CAGTG[0,0,0] p1', 10, '3', 'short-seed counterpart to CACTG_seed12'),
    ('09_DTC_CCC_seed12.pat', 'DTC animal/fungal CCC subset (Wicker 2007)', 'p1=2...2 CCC[0,0,0] p2=9...9 50...30000 ~p2 GGG[0,0,0] p1', 12, '2', 'historical Wicker classification scope'),
    ('10_DMM_Maverick_seed30.pat', 'DMM; outside TIR order', 'p1=6...6 p2=30...30 9940...19940 ~p2 p1', 30, '6', '30-bp terminal seed; TE length 10000-20000 bp; requires protein confirmation'),
    ('09_DTC_CACTA_relaxed1.pat', 'DTC plant CACTA subset', 'p1=3...3 CACTA[0,0,0] p2=7...7 50...30000 ~p2[1,0,0] TAGTG[0,0,0] p1', 12, '3', 'one substitution allowed in 7-bp p2; motif/TSD exact'),
]


def catalog(spark: SparkSession) -> DataFrame:
    """(pat_ord, file, candidate_group, pattern, terminal_seed_bp, tsd_test_bp, note) of the built-in patterns."""
    rows = [(k, *r) for k, r in enumerate(ELEMENTS)]
    return spark.createDataFrame(rows, "pat_ord int, file string, candidate_group string, pattern string, terminal_seed_bp int, tsd_test_bp string, note string")


def mismatched(pattern: str, mismatches: int, deletions: int = 0, insertions: int = 0) -> str:
    """A variant whose inverted repeat may differ."""
    return pattern.replace("~p2", f"~p2[{mismatches},{deletions},{insertions}]")
