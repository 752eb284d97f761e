"""Hand-made pages."""

ACT = """<!DOCTYPE html><html><head><style>.x{}</style><script>var t="</span>";</script></head><body>
<span class="S_DEN">LEGE nr. 121 din 30 aprilie 2024</span><span class="S_HDR">privind apa</span>
<span class="S_EMT_BDY">Parlamentul</span><span class="S_PUB_BDY">MONITORUL OFICIAL nr. 9 din 2 mai 2024</span>
<span class="S_TTL"><span class="S_TTL_TTL">Titlul I</span><span class="S_TTL_DEN">General &amp; apa &#259;&nbsp;</span></span>
<span class="S_CAP"><span class="S_CAP_TTL">Capitolul II</span><span class="S_CAP_DEN">Scop</span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 1</span><span class="S_ART_BDY"><span class="S_ALN"><span class="S_ALN_TTL">(1)</span><span class="S_ALN_BDY">Se aplică <a href="#">laalin.</a>
<span class="S_LIT"><span class="S_LIT_TTL">a)</span><span class="S_LIT_BDY">unu;</span></span><span class="S_LIT"><span class="S_LIT_TTL">b)</span><span class="S_LIT_BDY">doi</span></span></span></span>
<span class="S_ALN"><span class="S_ALN_TTL">(2)</span><span class="S_ALN_BDY">Al doilea alineat</span></span></span></span>
<span class="S_SEC"><span class="S_SEC_TTL">Secțiunea 1</span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 2</span><span class="S_ART_BDY"><span class="S_PAR">Un paragraf simplu și lung, peste cincizeci de caractere în total.</span></span></span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 3</span><span class="S_ART_BDY"><span class="S_LIT"><span class="S_LIT_TTL">a)</span><span class="S_LIT_BDY">prima literă;</span></span><span class="S_LIT"><span class="S_LIT_TTL">b)</span><span class="S_LIT_BDY">a doua literă</span></span></span></span></span></span>
<span class="S_TTL"><span class="S_TTL_TTL">Titlul II</span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 5</span><span class="S_ART_BDY">Text direct <b>îngroșat</b></span></span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 5</span><span class="S_ART_BDY"><span class="S_PAR">Introducere<span class="S_PCT"><span class="S_PCT_TTL">1.</span><span class="S_PCT_BDY">primul punct</span></span></span></span></span>
<span class="S_ART"><span class="S_ART_TTL">Articolul 6</span><span class="S_ART_BDY">abc</span></span></span></body></html>"""

MALFORMED = """<html><body><h1>Head &lt;one&gt;</h1><script>var a="</p><p>no";</script><!-- <p>hidden</p> -->
<p><b>First <i>para<p>Second 1 < 2 &eacute;&#x219;<br>line</p><li>item</body>"""
