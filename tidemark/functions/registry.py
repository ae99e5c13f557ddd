"""The shipped registries: what reviewed categories and series of known sources measure, and which series accumulate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The categories of the central bank's series by what they measure.
PRICE_CATEGORIES = """
altin_fiyatlari_ankara_kuyumcular_ve_saatciler_odasi altin_piyasasi_bist doviz_kurlari gumus_piyasasi_bist degerlemesi_yapilan_konutlarin_birim_kiralari
""".split()
RATE_CATEGORIES = """
imalat_sanayi_kapasite_kullanim_orani imalat_sanayi_kapasite_kullanim_orani_mevsimsellikten_arindirilmis kredi_faiz_oranlari_akim kredi_faiz_oranlari_stok mevduat_faiz_oranlari_akim
temel_isgucu_gostergeleri_mevsimsellikten_arindirilmis
""".split()
FLOW_CATEGORIES = """
altin_ithalati_bist altin_para_basimi_cumhuriyet_ve_resad_altini_gram_hmb_darphane konut_ve_is_yeri_satis_istatistikleri_ikinci_el_satislar
konut_ve_is_yeri_satis_istatistikleri_ilk_el_satislar konut_ve_is_yeri_satis_istatistikleri_ipotekli_satislar konut_ve_is_yeri_satis_istatistikleri_toplam_satislar odemeler_dengesi_analitik_sunum
""".split()
STOCK_CATEGORIES = """
krediler_bankacilik_sektoru krediler_katilim_bankalari krediler_mevduat_bankalari para_arzi_ve_karsilik_kalemleri toplam_uluslararasi_rezervler
""".split()
INDEX_CATEGORIES = """
konut_fiyat_endeksi reel_efektif_doviz_kuru_tufe_bazli sanayi_uretim_endeksi_mevsim_ve_takvim_etkisinden_arindirilmis_tuik tuketici_fiyat_endeksi_genel_2003_100
tuketici_guven_endeksi_ve_tuketici_egilim_endeksleri yeni_kiraci_kira_endeksi yurt_ici_uretici_fiyat_endeksi
""".split()

# Income statement items that are reported since the start of the year.
YTD_ITEMS = """
aktiflerimizin_satisindan_elde_edilen_gelirler
alinan_kar_paylari
amortisman_giderleri
bankacilik_hizmetleri_gelirleri
bankalara_verilen_faizler_giderler
bankalardan_alinan_faizler_gelirler
diger_faiz_disi_kar_payi_disindaki_gelirler
diger_faiz_disi_kar_payi_disindaki_giderler
diger_faiz_ve_faiz_benzeri_gelirler_diger_gelirler
diger_faiz_ve_faiz_benzeri_giderler_diger_giderler
diger_provizyonlar
donem_net_kari_zarari_51_52
finansal_kiralama_gelirleri
finansal_kiralama_giderleri
genel_karsilik_provizyonu
gercege_uygun_deger_farki_k_z_yan_menk_deg_alinan_faizler
gud_farki_diger_kapsamli_gelire_yansitilan_menkul_degerlerden_alinan_faizler
ihrac_edilen_menkul_kiymetlere_verilen_faizler_odenen_kar_paylari
itfa_edilmis_maliyeti_uzerinden_degerlenen_menkul_degerlerden_alinan_faizler
kidem_tazminati_provizyonu
kredilerden_alinan_faizler_kar_paylari
kredilerden_alinan_faizler_kar_paylari:a_tuketici_kredilerinden_alinan_faizler_kar_paylari
kredilerden_alinan_faizler_kar_paylari:b_kredi_kartlarindan_alinan_faizler_kar_paylari
kredilerden_alinan_faizler_kar_paylari:c_taksitli_ticari_kredilerden_alinan_faizler_kar_paylari
kredilerden_alinan_faizler_kar_paylari:d_diger_kredilerden_alinan_faizler_kar_paylari
kredilerden_alinan_ucret_ve_komisyonlar
kredilerden_alinan_ucret_ve_komisyonlar:a_nakdi_kredilerden_alinan_ucret_ve_komisyonlar
kredilerden_alinan_ucret_ve_komisyonlar:b_gayrinakdi_kredilerden_alinan_ucret_ve_komisyonlar
mevduata_verilen_faizler_katilim_fonlarina_odenen_kar_paylari
net_faiz_kar_payi_geliri_gideri_15_23
para_piy_isl_alinan_faizler
para_piy_isl_verilen_faizler
personel_giderleri
prov_sonrasi_net_faiz_kar_payi_geliri_gideri_24_25
repo_islemlerine_verilen_faizler
takipteki_alacaklar_ozel_provizyonu
takipteki_alacaklardan_alinan_faizler_kar_paylari
ters_repo_islemlerinden_alinan_faizler
toplam_faiz_disi_kar_payi_disindaki_gelirler_27_30_31_32_33
toplam_faiz_disi_kar_payi_disindaki_giderler_35_44
toplam_faiz_kar_payi_gelirleri_1_14_2_3_4_5
toplam_faiz_kar_payi_giderleri_16_22
vergi_oncesi_kar_zarar_26_34_50_45
vergi_provizyonu
vergi_resim_harc_ve_fonlar
verilen_ucret_ve_komisyonlar
""".split()

#: Source names, as the first part of a series' id has them.
CENTRAL, MONTHLY, WEEKLY, REGIONAL = "EVDS", "BDDK_MONTHLY", "BDDK_WEEKLY", "BDDK_FINTURK"

RULE = "priority int, source string, category string, series_id string, id_suffix string, accumulates boolean, nature string, override string"


def nature_rules(spark: SparkSession) -> DataFrame:
    """The shipped rules for ``nature.classified``: exact ids before anything else, what accumulates before suffixes, suffixes before categories, a source's default last."""
    rows = [(CENTRAL, None, f"{CENTRAL}:TP.APIFON1.IHA", None, None, "stock", "mean"), (CENTRAL, None, f"{CENTRAL}:TP.APIFON4", None, None, "rate", None)]
    rows += [(MONTHLY, None, None, None, True, "stock", None), (MONTHLY, None, None, "_periodic", None, "flow", None), (MONTHLY, "kar_zarar", None, None, None, "flow", None)]
    rows += [(MONTHLY, c, None, None, None, "rate", None) for c in ("rasyolar", "yurt_disi_sube_rasyolari")]
    rows += [(REGIONAL, "t5", None, None, None, "rate", None)]
    by_nature = [(PRICE_CATEGORIES, "price", None), (RATE_CATEGORIES, "rate", None), (FLOW_CATEGORIES, "flow", None), (STOCK_CATEGORIES, "stock", None), (INDEX_CATEGORIES, "stock", "mean")]
    rows += [(CENTRAL, c, None, None, None, nature, override) for categories, nature, override in by_nature for c in categories]
    rows += [(s, None, None, None, None, "stock", None) for s in (MONTHLY, WEEKLY, REGIONAL)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RULE)


def accumulation_registry(spark: SparkSession) -> DataFrame:
    """(series_id, accumulation) of the reviewed series that accumulate; all others do not, however they look."""
    return spark.createDataFrame([(f"{MONTHLY}:kar_zarar:{i}", "ytd") for i in YTD_ITEMS], "series_id string, accumulation string")
