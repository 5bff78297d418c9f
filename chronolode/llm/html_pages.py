"""Labelled pages from which the weights of main-text extraction are learned: {n} stands for n words, [[n]] for n words of main text.

Skeletons in the manner of common kinds of sites; what is main text was marked by hand.
"""

LABELLED = (
    # news
    '<html><head></head><body><nav><ul><li><a href="">{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li></ul></nav><div class="ad">{9}</div><article><h1>[[9]]</h1><p><b>[[40]]</b><br><p>[[60]]</p><p>[[30]]</p></article><footer>{12}</footer></body></html>',
    '<body><header class="site-header"><a>{2}</a><p class="tagline">{5}</p></header><main><h1>[[7]]</h1><div class="byline">[[4]]</div><p>[[50]]</p><aside><p>{20}</p></aside><p>[[45]]</p><h2>[[4]]</h2><ul><li>[[8]]</li><li>[[9]]</li></ul><p>[[70]]</p></main><aside class="sidebar"><ul><li><a>{3}</a></li><li><a>{4}</a></li></ul></aside><footer class="site-footer"><p>{9}</p></footer></body>',
    '<body><div id="masthead"><a>{2}</a></div><div class="breaking-news banner"><a>{8}</a></div><div class="story-body"><h1 class="headline">[[10]]</h1><p>[[40]]</p><div class="advertisement">{14}</div><p>[[45]]</p><figure><figcaption>[[12]]</figcaption></figure><p>[[60]]</p></div><section class="most-read"><h2>{2}</h2><ol><li><a>{8}</a></li><li><a>{9}</a></li><li><a>{7}</a></li></ol></section><div class="social-share"><span>{1}</span><a>{1}</a></div></body>',
    '<body><div class="topbar"><a>{1}</a><a>{1}</a></div><article class="story"><header class="article-header"><h1>[[8]]</h1><p class="standfirst">[[20]]</p></header><div class="article-body"><p>[[50]]</p><div class="inline-newsletter newsletter"><p>{16}</p></div><p>[[60]]</p><div class="related-stories"><h3>{2}</h3><ul><li><a>{7}</a></li></ul></div><p>[[40]]</p></div><div class="article-tags"><a>{1}</a><a>{1}</a></div></article><div class="sponsored promo">{25}</div><div class="copyright">{10}</div></body>',
    # weblogs
    '<body><div id="header"><h1>{3}</h1></div><div id="nav" class="navbar"><a>{1}</a><a>{1}</a><a>{2}</a></div><div id="content"><div class="post hentry"><h2 class="entry-title">[[6]]</h2><div class="entry-content"><p>[[55]] <a>[[2]]</a> [[20]]</p><p>[[80]]</p><blockquote>[[25]]</blockquote><p>[[35]]</p></div><div class="sharedaddy share-buttons"><span>{3}</span></div></div><div id="comments" class="comments-area"><h3 class="comments-title">{3}</h3><ol class="comment-list commentlist"><li class="comment"><div class="comment-body"><p>{20}</p></div></li><li class="comment"><div class="comment-body"><p>{15}</p></div></li></ol><div id="respond" class="comment-respond"><form class="comment-form"><label>{1}</label><p>{9}</p></form></div></div></div><div id="sidebar" class="widget-area"><div class="widget widget_recent_entries"><h4>{2}</h4><ul><li><a>{5}</a></li></ul></div><div class="widget"><p>{20}</p></div></div><div id="footer">{10}</div></body>',
    '<body><div class="container has-sidebar"><main class="site-main"><article class="post"><header class="entry-header"><h1 class="entry-title">[[8]]</h1><div class="entry-meta">{4}</div></header><div class="entry-content"><p>[[70]]</p><p>[[50]]</p></div><footer class="entry-footer">{6}</footer></article><nav class="post-navigation"><a>{5}</a><a>{6}</a></nav><div class="author-box"><p>{30}</p></div><section class="related-posts"><h3>{2}</h3><article><a>{6}</a></article><article><a>{5}</a></article></section><div id="disqus_thread" class="discussion">{30}</div></main><div class="sidebar widget-area">{25}</div></div></body>',
    '<body><div class="cookie-notice cookie-banner">{18}<button>{1}</button></div><div class="site-nav"><a>{2}</a> <a>{2}</a> <a>{1}</a></div><div class="wrapper"><div class="blog-post"><h2 class="post-title">[[5]]</h2><div class="post-content"><div>[[40]]</div><div>[[60]]</div></div><div class="post-share">{4}</div><div class="post-comments"><p>{40}</p></div></div></div><form class="subscribe-form signup"><label>{2}</label><input><p>{10}</p></form><div class="pagination pager"><a>{3}</a><a>{4}</a></div></body>',
    '<body><section class="hero-banner promo-banner">{12}</section><div class="post-body"><h1 class="title">[[7]]</h1><p class="lead">[[30]]</p><p>[[80]]</p><pre>[[30]]</pre><p>[[50]]</p></div><div class="newsletter-signup"><h3>{4}</h3><p>{18}</p></div><div class="recommended recommendations"><div><a>{7}</a></div><div><a>{6}</a></div></div><div class="replies"><div class="reply"><p>{25}</p></div></div></body>',
    # pages without names
    '<body><table><tr><td><a>{2}</a></td><td><a>{1}</a></td><td><a>{1}</a></td></tr></table><h1>[[8]]</h1><p>[[70]]<p>[[30]]<p>[[50]]<hr><p class="copyright">{8}</p></body>',
    '<body><div><a>{1}</a> | <a>{1}</a> | <a>{1}</a></div><h1>[[4]]</h1><p>[[20]]</p><ul><li>[[6]]<li>[[9]] <a>[[1]]</a><li>[[12]]</ul><div class="promo">{6}</div><p>[[60]]</p><ol><li>[[10]]</li><li>[[15]]</li></ol></body>',
    '<body><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul><div><div><h1>[[5]]</h1><div>[[90]]</div><div>[[45]]</div><table><tr><th>[[2]]</th><td>[[6]]</td></tr><tr><td>[[8]]</td></tr></table></div></div></body>',
    # documentation, reference works
    '<body><div role="navigation" class="related"><a>{1}</a><a>{1}</a><a>{1}</a></div><div class="document"><div class="body" role="main"><section id="introduction"><h1>[[3]]</h1><p>[[50]]</p><div class="admonition note"><p>[[20]]</p></div><div class="highlight"><pre>[[40]]</pre></div><p>[[40]]</p></section></div></div><div class="sphinxsidebar sidebar"><h3>{2}</h3><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{2}</a></li></ul><div id="searchbox" role="search"><form class="search"><label>{1}</label></form></div></div><div class="footer" role="contentinfo">{9}</div></body>',
    '<body><a class="skip-link">{3}</a><header class="page-header navbar"><a>{1}</a><div class="search-box search">{2}</div></header><nav class="breadcrumb breadcrumbs"><a>{1}</a><a>{2}</a><a>{1}</a></nav><div class="sidebar-menu menu"><ul><li><a>{2}</a></li><li><a>{2}</a></li><li><a>{2}</a></li></ul></div><div class="markdown-body content"><h1>[[4]]</h1><p>[[60]]</p><h2>[[3]]</h2><p>[[40]]</p><pre><code>[[30]]</code></pre></div><div class="toc"><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{2}</a></li></ul></div></body>',
    '<body><div id="siteNotice" class="notice">{15}</div><div id="mw-page-base"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">[[2]]</h1><div id="bodyContent"><div id="mw-content-text"><p>[[80]] <a>[[2]]</a> [[20]]</p><div class="thumb"><div class="thumbcaption">[[10]]</div></div><p>[[70]]</p><h2>[[1]]</h2><p>[[60]]</p></div></div></div><div id="mw-navigation" class="navigation"><a>{1}</a><a>{2}</a><a>{1}</a></div><div id="mw-panel" class="toolbar"><a>{2}</a><a>{2}</a><a>{2}</a></div><div id="footer" role="contentinfo"><ul><li>{12}</li></ul></div></body>',
    '<body><div class="page"><div class="guide"><h1>[[5]]</h1><div class="report-section section"><p>[[40]]</p></div><div class="results"><p>[[30]]</p><table class="data"><tr><td>[[4]]</td><td>[[3]]</td></tr></table></div><div class="summary"><p>[[35]]</p></div></div><div class="legal-disclaimer disclaimer">{25}</div></div></body>',
    # forms around everything, notices, overlays
    '<body><form id="aspnetForm"><div class="login-panel login"><label>{1}</label><input><button>{1}</button></div><div class="main-menu"><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li></ul></div><div id="main" class="main-content"><h1>[[6]]</h1><p>[[60]]</p><p>[[40]]</p></div><div id="bottom" class="page-footer">{8}</div></form></body>',
    '<body><div class="gdpr-consent consent-dialog" role="dialog"><p>{30}</p><button>{1}</button></div><div class="modal popup overlay"><div class="modal-content"><p>{15}</p></div></div><div class="alert notification" role="alert">{9}</div><div itemprop="articleBody" class="article-text text"><p>[[60]]</p><p>[[50]]</p><p>[[55]]</p></div><div class="privacy-notice"><p>{20}</p></div><div class="social"><a>{1}</a><a>{1}</a><a>{1}</a></div></body>',
    '<body><div class="ads adsense">{10}</div><div class="ad-container"><span>{4}</span></div><nav><a>{1}</a><a>{1}</a></nav><article><header><h1>[[6]]</h1></header><p>[[12]]</p><div class="ad-slot ad">{8}</div><p>[[9]]</p></article><section class="related"><h3>{2}</h3><a>{6}</a><a>{5}</a></section><div class="sponsor sponsored-content">{12}</div><footer>{14}</footer></body>',
    '<body><div class="banner">{10}</div><article><h2>[[3]]</h2><p>[[4]]</p></article><div class="latest-posts recent-posts"><ul><li><a>{4}</a></li><li><a>{5}</a></li></ul></div><footer class="footer"><div class="footer-content">{20}</div></footer></body>',
    '<body><main><article><h1>[[5]]</h1><p>[[90]]</p><div class="share">{3}</div><pre>[[20]]</pre><p>[[40]]</p><p>[[20]] <span class="share-link">{1}</span> [[10]]</p></article><section id="comments" class="comments"><h2>{1}</h2><div class="comment"><p>{30}</p></div></section></main></body>',
    # shops, boards, letters, laws
    '<body><div class="menu-bar menu"><a>{1}</a><a>{1}</a><a>{1}</a></div><div class="product"><h1 class="product-title">[[5]]</h1><div class="description"><p>[[50]]</p><ul><li>[[7]]</li><li>[[8]]</li></ul></div></div><div class="reviews comments"><div class="review"><p>{25}</p></div></div><div class="recommendations"><a>{3}</a><a>{4}</a><a>{3}</a></div><aside class="widget">{8}</aside></body>',
    '<body><header><nav class="nav-menu nav"><a>{1}</a><a>{1}</a><a>{1}</a></nav></header><div role="main"><section class="chapter"><h2>[[3]]</h2><p>[[100]]</p><p>[[80]]</p></section><section class="chapter"><h2>[[3]]</h2><p>[[90]]</p></section></div><aside role="complementary"><div class="subscribe subscription">{14}</div></aside><footer role="contentinfo"><p>{8}</p></footer></body>',
    '<body><header role="banner"><div class="logo">{2}</div></header><div class="layout two-column"><div class="col-main column"><div class="text-block"><h1>[[6]]</h1><p>[[50]]</p></div><div class="text-block"><p>[[60]]</p></div></div><div class="col-side side"><h4>{2}</h4><p>{15}</p></div></div><div class="share-bar social-links"><a>{1}</a><a>{1}</a><a>{1}</a></div><div class="bottom-nav nav"><a>{1}</a><a>{1}</a><a>{2}</a></div></body>',
    # applications, listings, boards
    '<body class="home"><header><a>{2}</a></header><div id="main" class="main"><h1>[[4]]</h1><div class="intro"><p>[[30]]</p></div><div class="text"><p>[[70]]</p><p>[[40]]</p></div></div><div class="teasers"><article class="teaser card"><a>{6}</a><p>{8}</p></article><article class="teaser card"><a>{6}</a><p>{9}</p></article></div><footer>{9}</footer></body>',
    '<body><div id="wrapper" class="page-wrapper"><main id="main" class="content-main"><h1>[[5]]</h1><section><p>[[60]]</p></section><section><p>[[60]]</p></section></main><div id="sidebar-right" class="sidebar-right"><div class="ad-box"><span>{3}</span></div><ul class="link-list"><li><a>{2}</a></li><li><a>{2}</a></li><li><a>{3}</a></li></ul></div></div><div class="breadcrumb-nav"><a>{1}</a><a>{1}</a><a>{2}</a></div></body>',
    '<body><div class="forum"><div class="search-form"><form><label>{1}</label></form></div><div id="main"><div class="topic-title"><h1>[[7]]</h1></div><div class="message first-post"><div class="message-body body-text"><p>[[60]]</p><p>[[30]]</p></div></div></div><div class="replies"><div class="message reply"><p>{20}</p></div><div class="message reply"><p>{30}</p></div></div><div class="forum-footer footer">{6}</div></div></body>',
    '<body><div class="page-header"><div class="site-title">{2}</div></div><main role="main"><article><div class="entry"><h1 class="entry-title">[[6]]</h1><p class="entry-lead">[[25]]</p><p>[[60]]</p></div></article></main><div class="cookie-consent" role="alertdialog"><p>{20}</p></div><div class="terms-notice notice">{15}</div></body>',
)
