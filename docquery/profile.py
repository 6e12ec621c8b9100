"""What depends on the kind of document: patterns, word lists and weights."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Lines of running heads and signature blocks, in their order.
HEADERS = (
    r"(?ms)^\s*PRESIDEN\s*REPUBLIK\s*INDONESIA,?\s*\n(?:\s*\n)?(?:\s*ttd\.?\s*\n)?\s*[A-Z][A-Z .,]{3,}\s*$",
    r"(?ms)^\s*SEKRETARIS\s+NEGARA\s*REPUBLIK\s*INDONESIA,?\s*\n(?:\s*\n)?(?:\s*ttd\.?\s*\n)?\s*[A-Z][A-Z .,]{3,}\s*$",
    r"(?ms)^\s*MENTERI\s+[A-Z .,&/]{3,}\s*\n(?:\s*\n)?(?:\s*ttd\.?\s*\n)?\s*[A-Z][A-Z .,]{3,}\s*$",
    r"(?ms)^\s*[|,Il.:;\-]*\s*PRESIDEN\s*REPUBLIK\s*INDONESIA,?\s*\n(?:\s*\n)?(?:\s*ttd\.?\s*\n)?\s*[A-Z][A-Z .,]{3,}\s*$",
    r"(?ms)^\s*ttd\.?\s*\n(?:\s*\n)?\s*[A-Z][A-Z .,]{3,}\s*$",
    r"(?m)^\s*[,|.:\-\s]*(?:PRESIDEN|REPUBLIK\s*INDONESIA|IN[Dd]ONESIA|INgONESIA)[,.]?\s*$",
    r"(?m)^\s*PRESIDEN\s*REPUBLIK\s*INDONESIA,?\s*$",
    r"(?m)^\s*PRESIDEN\s*$",
    r"(?m)^\s*REPUBLIK\s*INDONESIA\s*$",
    r"(?m)^\s*Disahkan di[^\n]*$",
    r"(?m)^\s*(?:TAMBAHAN\s+)?LEMBARAN\s+NEGARA[^\n]*$",
    r"(?m)^\s*(?:TAMBAHAN\s+)?BERITA\s+NEGARA[^\n]*$",
    r"(?m)^\s*KEMENTERIAN\s+SEKRETARIAT[^\n]*$",
    r"(?m)^\s*SEKRETARIS\s+NEGARA[^\n]*$",
    r"(?m)^\s*(UNDANG-UNDANG|PERATURAN\s+PEMERINTAH|PERATURAN\s+PRESIDEN|PERATURAN\s+MENTERI)\s+REPUBLIK\s*INDONESIA\s*$",
    r"(?m)^\s*NOMOR\s+\d+\s+TAHUN\s+\d+\s*$",
    r"(?m)^\s*TENTANG\s*$",
    r"(?m)^\s*DENGAN RAHMAT TUHAN YANG MAHA ESA\s*$",
    r"(?m)^\s*MEMERINTAHKAN[^\n]*$",
    r"(?m)^\s*AGAR SETIAP ORANG[^\n]*$",
    r"(?m)^\s*SK\s*No\.?\s*[^\n]*$",
    r"(?m)^\s*Salinan\s+sesuai\s+dengan\s+aslinya[^\n]*$",
    r"(?m)^\s*Diundangkan[^\n]*$",
    r"(?m)^\s*Ditetapkan di[^\n]*$",
    r"(?m)^\s*pada tanggal[^\n]*$",
    r"(?m)^\s*ttd\.?\s*$",
    r"(?m)^\s*MENTERI\s+[A-Z\s.,]{3,}$",
    r"(?m)^\s*(Pasal|Ayat)\s*$",
    r"(?m)^\s*Pasal\s+\d+[A-Za-z]?(?:\s*\.){2,}\s*$",
    r"(?m)^\s*(?:BAB|Bagian|Paragraf)\s*[IVXLC0-9]+\s*\.{2,}\s*$",
    r"(?m)^\s*\d+(?:\s*\.){2,}\s*$",
    r"(?m)^\s*[IVXLC]{1,3}\s*$",
    r"(?m)^\s*[l|!]{1,3}\s*$",
)

#: Inline watermarks.
WATERMARKS = (r"(?i)jdih[^\n]*", r"(?i)www\.[^\s]+", r"(?i)direktorat jenderal peraturan perundang-undangan[^\n]*")

#: An everyday word and the words or phrases that statutes use for it.
SYNONYMS = {
    "hukuman": ["pidana", "denda", "sanksi", "penjara", "kurungan"],
    "sanksi": ["pidana", "denda"],
    "cabul": ["asusila", "kesusilaan", "percabulan", "pencabulan", "mesum"],
    "persetubuhan": ["setubuh", "bersetubuh", "zina", "perzinaan", "senggama"],
    "sesama jenis": ["sesama kelamin", "sama jenis", "sejenis"],
    "gay": ["sesama kelamin", "sama jenis"],
    "lesbian": ["sesama kelamin", "sama jenis"],
    "lgbt": ["sesama kelamin", "sama jenis"],
    "perkosaan": ["pemerkosaan", "rudapaksa", "kekerasan seksual"],
    "kekerasan": ["kekerasan seksual", "perbuatan kekerasan", "memaksa"],
    "bunuh": ["pembunuhan", "membunuh", "menghilangkan nyawa"],
    "curi": ["pencurian", "mencuri"],
    "korupsi": ["tipikor", "melawan hukum", "memperkaya diri", "suap"],
    "suap": ["penyuapan", "gratifikasi", "hadiah"],
    "menyuap": ["penyuapan", "suap"],
    "narkoba": ["narkotika", "psikotropika"],
    "tahan": ["penahanan", "ditahan", "tahanan", "rutan", "penangkapan"],
    "tangkap": ["penangkapan", "ditangkap"],
    "cerai": ["perceraian", "talak", "gugat cerai"],
    "kawin": ["perkawinan", "nikah", "menikah"],
    "nikah": ["perkawinan", "menikah"],
    "waris": ["ahli waris", "pewaris", "pewarisan"],
    "pengacara": ["advokat", "kuasa hukum", "penasihat hukum"],
    "jaksa": ["penuntut umum", "penuntut"],
    "polisi": ["kepolisian", "penyidik", "polri"],
    "saksi": ["kesaksian", "alat bukti", "keterangan saksi"],
    "terdakwa": ["tersangka", "terdakwa"],
    "tanah": ["pertanahan", "agraria", "hak atas tanah"],
    "pajak": ["perpajakan", "ketentuan umum perpajakan", "wajib pajak"],
    "utang": ["piutang", "kewajiban pembayaran", "pailit", "pkpu"],
    "pailit": ["kepailitan", "pkpu"],
    "buruh": ["pekerja", "ketenagakerjaan", "tenaga kerja"],
    "kerja": ["pekerja", "ketenagakerjaan"],
    "phk": ["pemecatan", "pemutusan hubungan kerja", "pesangon"],
    "pesangon": ["pemutusan hubungan kerja", "uang pesangon"],
    "konsumen": ["perlindungan konsumen", "pelaku usaha"],
    "anak": ["di bawah umur", "belum dewasa", "perlindungan anak"],
    "remaja": ["di bawah umur", "belum dewasa", "anak"],
    "kekerasan_rumah_tangga": ["kdrt", "dalam rumah tangga"],
    "lingkungan": ["pencemaran", "lingkungan hidup", "perusakan"],
    "merek": ["hak merek", "kekayaan intelektual"],
    "hakcipta": ["hak cipta", "ciptaan", "kekayaan intelektual"],
    "ktp": ["kartu tanda penduduk", "administrasi kependudukan"],
    "pajak_kendaraan": ["bea balik nama", "kendaraan bermotor"],
    "tilang": ["pelanggaran lalu lintas", "lalu lintas"],
    "bea": ["beacukai", "pabean", "cukai"],
    "impor": ["pabean", "bea masuk"],
    "ekspor": ["pabean", "bea keluar"],
    "teroris": ["terorisme", "tindak pidana terorisme"],
    "judi": ["perjudian", "lotre", "taruhan"],
    "zina": ["perzinaan", "persetubuhan"],
    "mesum": ["asusila", "kesusilaan", "cabul"],
}

#: Pattern of a question, markers in the text, weight; in order.
INTENTS = (
    (r"hukum|sanksi|ancaman|dihukum|konsekuensi|akibat", ("dipidana", "denda", "penjara", "kurungan"), 0.16),
    (r"apa itu|definisi|maksud|pengertian|arti", ("yang dimaksud", "adalah"), 0.12),
    (r"boleh|dapatkah|bolehkah|diperbolehkan|sah", ("dapat", "boleh", "diperbolehkan"), 0.12),
    (r"dilarang|larangan|terlarang|ilegal|haram", ("dilarang", "tidak boleh"), 0.16),
    (r"syarat|prasyarat|ketentuan|prosedur|tata cara|cara", ("syarat", "ketentuan", "tata cara"), 0.10),
    (r"kapan|bilamana|kondisi|keadaan", ("dalam hal", "apabila"), 0.10),
    (r"siapa|pelaku|subjek|pihak", ("setiap orang", "pelaku"), 0.10),
)

#: Pattern of a question, pattern of the titles it then names.
ALIASES = (
    (r"\bkuhp\b|kitab undang.{0,5}undang hukum pidana", r"hukum pidana|\bkuhp\b"),
    (r"\bkuhp\s+lama\b|wetboek|\bwvs\b|kuhp\s+1946", r"kuhp lama|wetboek"),
    (r"\bkuhap\b|hukum acara pidana", r"acara pidana"),
    (r"\bkuh\s?per(data)?\b", r"perdata"),
    (r"\bite\b|transaksi elektronik", r"informasi dan transaksi elektronik"),
    (r"\b(tipikor|korupsi|korup)\b", r"korupsi"),
    (r"\bumkm\b", r"usaha mikro"),
    (r"\b(cipta\s?kerja|omnibus)\b", r"cipta kerja"),
    (r"\bperlindungan anak\b", r"perlindungan anak"),
    (r"\bkdrt\b|kekerasan dalam rumah tangga", r"rumah tangga"),
    (r"\btpks\b|kekerasan seksual", r"kekerasan seksual"),
)

#: Words too common to name a topic.
STOPWORDS = (
    "apa itu yang dan atau ke dari dalam pada untuk dengan adalah ini atas bawah serta juga dapat bisa tidak bukan tentang berapa bagaimana "
    "mengapa kapan siapa pasal uu undang nomor tahun ayat hukum pidana sanksi aturan peraturan pengaturan jelaskan maksud arti pengertian "
    "ketentuan mengatur diatur bagi terhadap oleh orang setiap mana saat"
).split()

#: Parts of phrases too common to stand alone.
GENERIC_PARTS = ["sama", "jenis", "lain", "orang", "dengan", "kepada", "dalam", "untuk", "perkara", "kata", "segala", "hal", "yang", "suatu"]

#: Repealed document and what replaces it.
SUPERSEDED = {"1-1946": "UU No. 1 Tahun 2023", "8-1981": "UU No. 20 Tahun 2025", "36-2009": "UU No. 17 Tahun 2023", "6-2018": "UU No. 17 Tahun 2023"}

#: Normative markers and their weights.
MARKERS = (("dipidana", 10), ("denda", 8), ("dilarang", 7), ("wajib", 6), ("dikenakan", 5), ("berhak", 4), ("kewajiban", 3), ("hak", 1))

#: Misread letter pairs and what they may stand for, in order.
PAIRS = {"rn": ["m", "n"], "cl": ["d"], "vv": ["w"], "lh": ["k"], "tl": ["t"], "hn": ["m"], "nh": ["m"]}

#: Misread glyphs and what they may stand for.
GLYPHS = {
    "€": ["e", "a", "o"], "£": ["e"], "¥": ["y"], "§": ["s"], "†": ["t"], "‡": ["t"], "¶": ["p"], "©": ["c"], "®": ["r"], "<": ["k", "c"], ">": ["j"],
    "|": ["l", "i"], "ℓ": ["l"], "0": ["o"], "1": ["l", "i"], "4": ["a"], "5": ["s"], "6": ["g", "b"], "7": ["t"], "8": ["b"], "9": ["g"], "3": ["e"],
}

#: A token; forms of tokens that are Roman numerals, in small letters, capitalised; a letter split off before or behind a word.
TOKEN = r"[A-Za-zÀ-ÿ€£§†‡¶©®<>|ℓ¥]+"
ROMAN = r"^[ivxlcdm]+$"
PLAIN = r"^[a-zà-ÿ]+$"
CAPITAL = r"^[A-ZÀ-Þ][a-zà-ÿ]+$"
SPLIT_HEAD = r"(?U)(?<![\w/.-])([a-zA-ZÀ-ÿ])\s+([a-zà-ÿ]{3,})(?![\w/-])"
SPLIT_TAIL = r"(?U)(?<![\w/-])([a-zà-ÿ]{3,})\s+([a-zA-ZÀ-ÿ])(?![\w.-])"


@dataclass(frozen=True)
class Profile:
    """Patterns are in the dialect of Java (and mostly of Python). The defaults
    are fixed values."""

    page_mark: str = r"(?m)^\s*<<<PAGE\s+(\d+)>>>\s*$"
    guard: str = r"^\s*(Pasal|Ayat\s*\(|BAB\b|Bagian\b|Paragraf\b|PENJELASAN|MENIMBANG|MENGINGAT|MEMUTUSKAN|Menetapkan|KETENTUAN\s+UMUM|LAMPIRAN)\b"
    sentence_end: str = r"[.:;!?\"')\]]$"
    continued: str = r"^\s*[a-z0-9(\-]"
    bare_mark: str = r"^\s*(Pasal|Ayat|BAB|Bagian|Paragraf)\s*$"
    mark_line: str = r"^\s*(Pasal|Ayat|BAB|Bagian|Paragraf)\b"
    heading: str = r"(?m)^\s*Pasal\s+(\d+[A-Za-z]?)\s*$"
    paragraph: str = r"(?m)^\s*\(\d+\)"
    structure: str = r"(?m)^\s*(BAB|Bagian|Paragraf)\s+([IVXLCDMivxlcdm0-9)(.\-]+)[ \t]*([^\n]*)\n(?:\s*([^\n]+)\n)?|^\s*(PENJELASAN)[ \t]*([^\n]*)\n(?:\s*([^\n]+)\n)?"
    structure_lines: tuple[str, ...] = (
        r"(?m)^\s*(?:BAB|Bagian|Paragraf)\s+[IVXLCDMivxlcdm0-9)(.\-]+[^\n]*\n(?:\s*[A-Z][A-Z0-9\s.,()\-/]{2,80}\n)?",
        r"(?m)^\s*(?:Pasal|Ayat|BAB|Bagian|Paragraf)\s*$",
    )
    law_citation: str = r"(?:Undang-Undang|UU)\s+(?:Republik\s+Indonesia\s+)?(?:Nomor|No\.?)\s+(\d+[A-Za-z]?)\s+Tahun\s+(\d{4})"
    article_citation: str = r"\bPasal\s+(\d+[A-Za-z]?)\b"
    citation_window: int = 120
    file_name: str = r"(?i)^uu-(\d+[A-Za-z]?)-(\d{4})_(.+)$"
    explanation: str = "PENJELASAN"
    max_words: int = 800
    headers: tuple[str, ...] = HEADERS
    watermarks: tuple[str, ...] = WATERMARKS
    synonyms: dict = field(default_factory=lambda: SYNONYMS)
    intents: tuple = INTENTS
    aliases: tuple = ALIASES
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    generic_parts: tuple[str, ...] = tuple(GENERIC_PARTS)
    superseded: dict = field(default_factory=lambda: SUPERSEDED)
    markers: tuple = MARKERS


INDONESIAN_LAW = Profile()

#: For plain prose: no headings of statutes, English words.
GENERIC = replace(
    INDONESIAN_LAW,
    guard=r"^\s*(Chapter|Section)\b",
    stopwords=("the", "of", "and", "to", "in", "that", "with", "from", "this", "for"),
    intents=(("who|person", ("person", "people"), 0.1), ("rent|thing", ("rent", "thing"), 0.12)),
    synonyms={"thing": ["thon", "ther"], "water": ["shst"]},
    aliases=(("source zero", r"src0\b"), ("source one", r"src1\b")),
    markers=(("thing", 10), ("rent", 8), ("with", 5), ("that", 1)),
    superseded={"src3": "src4", "src7": "src8"},
    headers=(),
)
