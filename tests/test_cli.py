from brandloom.plans.cli import main
from brandloom.sources import tables


def test_the_whole_way(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    source = tmp_path / "products.csv"
    names = ["Azithral 500 Tablet", "Azithrel 500 Tablet", "Dolo 650 Tablet", "Dolo Syrup", "Olez-D Tablet", "Olex Tablet"]
    cells = ["Azithromycin (500mg)", "Azithromycin (500mg)", "Paracetamol (650mg)", "Ibuprofen (100mg/5ml)", "Omeprazole (20mg)", "Neem"]
    source.write_text("name,short_composition1,type\n" + "".join(f"{n},{c},allopathy\n" for n, c in zip(names, cells, strict=True)) + "Blank,,allopathy\n")
    main(["census", str(source), "--outdir", out])
    main(["clean", f"{out}/brand_roots", "--outdir", out])
    known = tmp_path / "known.csv"
    known.write_text("root_a,root_b\nazithrel,azithral\nx,y\n")
    main(["block", f"{out}/brand_roots_clean", "--outdir", out, "--check", str(known)])
    main(["score", f"{out}/candidate_pairs", "--outdir", out])
    main(["rank", f"{out}/scored_pairs", "--top", "3", "--out", f"{out}/top"])
    main(["coverage", f"{out}/molecules", "--outdir", out])
    main(["short-roots", f"{out}/collisions_molecule"])
    best = tables.read_csv(spark, f"{out}/top", tables.SCORED).first()
    assert {best["root_a"], best["root_b"]} == {"azithral", "azithrel"} and float(best["score"]) == 0.905
    assert spark.read.option("header", True).csv(f"{out}/molecules_atc").count() == 5
    assert spark.read.option("header", True).csv(f"{out}/parse_failures").count() == 1
    assert "not in roots" in capsys.readouterr().out
