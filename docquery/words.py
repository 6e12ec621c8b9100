"""Word lists of Indonesian statutes."""

#: Sound words that a general dictionary lacks, by groups: forms of statutes, foreign words, places and set terms.
TERMS = (
    "perundang undangan dipidana masing dugaan perpanjangan terjadinya diberhentikan sistemik diputus berakhirnya "
    "pelunasan dipersamakan pidananya terafiliasi terintegrasi matinya pembudi didakwakan trustee pascatambang terutang "
    "permusyawaratan diminta dikonsultasikan kepesertaan merekomendasikan dikoordinasikan dipersyaratkan dipekerjakan "
    "dilampiri dilikuidasi keterdapatannya berisiko termohon pemohon tersangka terdakwa terduga penuntut perkara "
    "pertanggungjawaban perkosaan tertuang dikategorikan terselenggaranya didaftar berwawasan dananya modalnya "
    "pelintas karboksilat advokatnya masuknya dimintakan dikemas dikehendaki diumumkan didasarkan permen "
    "sekurang diancamkan dilakukan dipergunakan perdagangkan perbankan perasuransian pengelolaan keterjangkauan "
    "didaftarkan diklasifikasikan pengoperasian dipertanyakan disempurnakan disebabkan dikaitkan dikecualikan "
    "dipertanggungjawabkan persengketaan penyandang dikurangkan sahamnya dipalsu kolegium manapun beralihnya "
    "apapun berserta permufakatan lambatnya selambat selambatnya pautnya menyitanya memperberat tama "
    "berdaerah reglement daripadanya terpaut berpaut kaitnya berkait sitasit penyitaan menyita "
    "disita penyita tersita penyitanya mutatis mutandis perbarengan dirusak dirusaki merusak tempatkan uniter "
    "out trade world netting international divisional organization convention pasca "
    "jakarta papua jawa sulawesi riau jambi bengkulu gorontalo halmahera nias barito buton konawe "
    "mongondow bolaang ogan april pancasila batubara staatsblad officio hoc sine idem adhoc"
).split()

#: Misread words that no rule mends, and what they stand for.
CURATED = {
    "unhrk": "untuk", "unttrk": "untuk", "unttik": "untuk", "uuk": "untuk",
    "repubuk": "republik", "repuelik": "republik", "nepublik": "republik", "nepuelik": "republik", "repijblik": "republik", "epublik": "republik",
    "epubl": "republik", "pubuk": "republik", "repueuk": "republik", "refublik": "republik", "nepubuk": "republik", "republtk": "republik",
    "indonesi": "indonesia", "ndonesia": "indonesia", "indone sia": "indonesia", "fresiden": "presiden", "presioen": "presiden", "esiden": "presiden",
    "inoonesia": "indonesia", "tndonesia": "indonesia", "donesia": "indonesia", "penghihrngan": "penghilangan", "rekapihrlasi": "rekapitulasi",
    "dimalsud": "dimaksud", "dirnaksud": "dimaksud", "malsud": "maksud", "sslagaimana": "sebagaimana", "verilikasi": "verifikasi",
    "verifrkasi": "verifikasi", "pertanggungiawaban": "pertanggungjawaban", "kabupatenlkota": "kabupaten/kota", "danlatau": "dan/atau",
    "abupaten": "kabupaten", "lhbupaten": "kabupaten", "ikbupaten": "kabupaten", "ihbupaten": "kabupaten", "igbupaten": "kabupaten", "gbupaten": "kabupaten",
    "bupaten": "kabupaten", "blik": "bilik", "bagran": "bagian", "hurufa": "huruf a", "hurufb": "huruf b", "hurufc": "huruf c",
    "hurufd": "huruf d", "hurufe": "huruf e", "huruff": "huruf f", "hurufg": "huruf g", "hurrf": "huruf", "huruh": "huruf",
    "uata": "atau", "ataun": "atau", "pasa": "pasal", "pasd": "pasal", "tqiuh": "tujuh", "tqjuh": "tujuh", "tqiun": "tujuh", "hatian": "harian",
    "sertilikat": "sertifikat", "pemagangan": "pemasangan", "puhrsan": "putusan", "didanakan": "didanai", "dalarn": "dalam", "ukupjelas": "cukup jelas",
    "pemyataan": "pernyataan", "agensia": "agensi", "jumlatr": "jumlah", "yangberlaku": "yang berlaku", "hanrs": "harus", "hanis": "harus",
    "keiadi": "kejadian", "sahr": "sah", "naryat": "rakyat", "ratyat": "rakyat", "rakyaf": "rakyat", "pelanstaran": "pelantaran",
    "enindaklanjutf": "menindaklanjuti", "sdg": "sedang", "gnay": "yang", "nagned": "dengan", "aisenodni": "indonesia",
    "anamiagabes": "sebagaimana", "nakukalid": "dilakukan", "naanitnarakek": "kekarantinaan", "tikaynep": "penyakit",
    "ysng": "yang", "ysag": "yang", "gany": "yang", "sng": "yang", "nagrep": "perang", "nadem": "medan", "lirma": "lima",
    "rat<yat": "rakyat", "pemeriksana": "pemeriksaan",
}
