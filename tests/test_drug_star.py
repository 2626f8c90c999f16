"""The drug star and its symbols on small tables in ChEMBL's layout."""

from causalake.sources import drugs


def test_star_on_named_tables(spark):
    make = spark.createDataFrame
    indications = make([(1, "Malaria, Cerebral", None, 4), (2, None, "malaria", 2), (3, "100% other", None, 1), (4, None, None, 3)], "molregno int, mesh_heading string, efo_term string, max_phase_for_ind int")
    molecules = make([(i, f"D{i}") for i in range(1, 5)], "molregno int, pref_name string")
    mechanisms = make([(1, 10, "inhibits"), (2, 10, "blocks"), (2, 11, "blocks"), (3, 10, "x"), (4, 10, "y")], "molregno int, tid int, mechanism_of_action string")
    targets = make([(10, "DHFR", "Plasmodium falciparum", "single protein"), (11, "T", "Homo sapiens", "unknown")], "tid int, pref_name string, organism string, target_type string")
    components = make([(10, 7)], "tid int, component_id int")
    sequences = make([(7, "P13922")], "component_id int, accession string")
    rows = drugs.star(indications, molecules, mechanisms, targets, components, sequences, "malaria")
    assert {(r.tid, r.drug, r.phase, r.accession) for r in rows.collect()} == {(10, "D1", 4, "P13922"), (10, "D2", 2, "P13922"), (11, "D2", 2, None)}
    assert drugs.star(indications, molecules, mechanisms, targets, components, sequences, "%").count() == 1
    up = {r.tid: (r.max_phase, r.n_drugs, r.n_mechanisms) for r in drugs.roll_up(rows).collect()}
    assert up == {10: (4, 2, 2), 11: (2, 1, 1)}
    assert [r.tid for r in drugs.top_targets(drugs.roll_up(rows).join(targets, "tid"), 5).collect()] == [10]


def test_pathogen_symbols_leave_out_words(spark):
    rows = [(1, "GENE_SYMBOL", "Protease", 1), (1, "UNIPROT", "DHFR-TS", 2), (2, "GENE_SYMBOL", "pol", 1), (2, "GENE_SYMBOL", "GP", 2), (3, "GENE_SYMBOL", "P", 1)]
    synonyms = spark.createDataFrame(rows, "component_id int, syn_type string, synonym string, ord int")
    assert {r.component_id: r.symbol for r in drugs.pathogen_symbols(synonyms).collect()} == {1: "DHFR-TS", 2: "GP"}
